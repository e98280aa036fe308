import random
import zlib
from collections import Counter

from flowlens.llm.sharding import shard_documents

SCHEMA = "doc_id long, text string, shard string, row string, n string"


def run(spark, rows, shards):
    df = spark.createDataFrame([(i, t, "s", "r", "n") for i, t in rows], SCHEMA).repartition(3)
    return shard_documents(df, shards).collect()


def check(rows, got, shards):
    raw = [(i, (t or "").encode()) for i, t in rows]
    key = lambda t: (t[0] is None, t)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=lambda t: (t[0] is None, t[0] or 0, t[1:])) == sorted(
        ((i, len(t) + 8, zlib.crc32(t)) for i, t in raw), key=lambda t: (t[0] is None, t[0] or 0, t[1:]))
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_balanced_and_together(spark):
    rnd = random.Random(4)
    rows = [(i, f"text {i}") for i in range(300)]
    rows += [(1000 + i, f"pair {i // 2}") for i in range(120)] + [(2000 + i, f"five {i // 5}") for i in range(100)]
    rows += [(3000 + i, "hot text é") for i in range(200)] + [(None, None), (None, ""), (5, "text 5"), (5, "text 5")]
    rnd.shuffle(rows)
    got = run(spark, rows, 8)
    check(rows, got, 8)
    where = {}
    for r in got:
        where.setdefault((r["size"], r["text_crc32"]), Counter())[r["shard"]] += 1
    small = [c for c in where.values() if 1 < sum(c.values()) < 100]
    assert sum(len(c) > 1 for c in small) <= 0.05 * len(small)
    hot = next(c for c in where.values() if sum(c.values()) == 200)
    assert len(hot) <= 4  # 200 rows need at least two shards of 90


def test_only_copies_few_rows_and_empty(spark):
    check(rows := [(i, "same") for i in range(50)], run(spark, rows, 4), 4)
    check(rows := [(1, "a"), (2, "b"), (3, "a")], run(spark, rows, 24), 24)
    assert run(spark, [], 24) == []
