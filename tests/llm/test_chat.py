import random

import duckdb

from flowlens.llm import queries
from flowlens.llm.chat import format_conversations

SCHEMA = "conv_id long, turn long, role string, text string, conv string, place string"


def brute(rows, part):
    logs = {}
    for c, t, r, x in set(rows):
        logs.setdefault(c, []).append((2**63 - 1 if t is None else t, r or "user" if r is None else r, x or ""))
    said = {c: tuple((r, x) for _, r, x in sorted(set(v))) for c, v in logs.items()}
    starts = {v[:k] for v in said.values() for k in range(1, len(v))}
    out = []
    for v in set(said.values()) - starts:
        ids = [c for c, w in said.items() if w == v]
        first = min((c for c in ids if c is not None), default=None)
        for p in range(0, len(v), part):
            text = "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v[p : p + part])
            out.append((first if first is not None else -1, p // part, len(v), len(ids), text))
    return sorted(out)


def run(spark, rows, part):
    df = spark.createDataFrame([(*r, "c", "p") for r in rows], SCHEMA).repartition(3)
    return sorted((r["conv_id"] if r["conv_id"] is not None else -1, r["part"], r["n_turns"], r["copies"], r["text"]) for r in format_conversations(df, part).collect())


def test_matches_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for c in range(120):
        base = rnd.randrange(12)
        for t in range(rnd.randint(1, 9)):
            branch = base if t < 4 else rnd.choice([base, base, base + 100])
            rows.append((c, t, ("user", "assistant")[t % 2], f"say {branch} {t}"))
    rows += [(500, t, "user", "hot") for t in range(3000)] + [(501, t, "user", "hot") for t in range(2500)]
    rows += [(None, 0, "user", "no id"), (None, None, None, None), (600, 1, "b", "tie"), (600, 1, "a", "tie"), (600, 1, "a", "tie"), (601, 5, "user", ""), (602, 5, None, None)]
    assert run(spark, rows, 256) == brute(rows, 256)


def test_empty(spark):
    assert run(spark, [], 4) == []


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want = con.execute("SELECT conv_id, part, n_turns, copies, text FROM (" + queries.ORACLE["op3_chat_snapshot_collapse"] + ")").fetchall()
    got = queries.QUERIES["op3_chat_snapshot_collapse"](spark, d).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and want
