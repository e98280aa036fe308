import hashlib
import random
import re
import zlib

from flowlens.llm import repair
from flowlens.llm.auction import FAR, Lattice, transfer

SCHEMA = "conv_id long, turn long, role string, text string, conv string, at long"


def damage(rows):
    out = []
    for c, t, r, x in rows:
        c, r, x = (" " if v is None else v for v in (c, r, x))
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """Dynamic programming over whole scripts: (cost, audit, repaired lines)."""
    def after(q, initial):
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, initial))

    def better(table, q, entry):
        if q is not None and (q not in table or entry[:2] < table[q][:2]):
            table[q] = entry

    def inserted(table):
        for _ in range(4):
            for q, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    better(table, after(q, role[0]), (cost + 2, audit + "I", lines + ((role, ""),)))
        return table

    table = {0: (0, "", ())}
    for (role, text), fault in zip(rows, faults):
        new = {}
        for q, (cost, audit, lines) in inserted(table).items():
            better(new, q, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                better(new, after(q, role[:1]), (cost + more, audit + "K", lines + ((role, text),)))
                for to in ("user", "assistant"):
                    better(new, after(q, to[0]), (cost + 2 + more, audit + "R", lines + ((to, text),)))
        table = new
    return min((e for q, e in inserted(table).items() if q in (0, 3)), key=lambda e: e[:2])


def brute(rows):
    talks = {r[0]: [] for r in rows}
    for c, t, r, x in damage(rows):
        talks[None if c == " " else c].append((t is not None, t or 0, r, x))
    out = {}
    for c, said in talks.items():
        said.sort()
        faults, seen = [], set()
        for _, _, r, x in said:
            bare = x.rstrip(repair.SPACE)
            faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((r, x))
        turns = [t for known, t, _, _ in said if known]
        cost, audit, lines = cheapest([(r, x) for _, _, r, x in said], faults)
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(said, said[1:])]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                  sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest())
    return out


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(3)
    got = repair.audit_conversations(df, **sizes).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def some_rows(seed, talks, most):
    rnd = random.Random(seed)
    rows = []
    for c in range(talks):
        for t in range(rnd.randint(1, most)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c, rnd.choice([t, t, t, None, t + 3]), role, rnd.choice(["Yes.", "no", "", " \n", None, "Well! ", f"say {t}.", "é?"])))
    return rows


def test_matches_brute_force(spark):
    rows = some_rows(1, 150, 9) + [(None, 0, "user", "no id."), (None, None, None, None), (900, 5, "system", "x" * 70_000), (901, 2**63 - 2, "user", "end.")]
    assert run(spark, rows) == brute(rows)


def test_long_conversations_in_blocks(spark):
    rows = some_rows(2, 2, 700) + some_rows(3, 60, 4)
    assert run(spark, rows, block_rows=8) == brute(rows)


def test_hot_null_conversation(spark):
    rows = [(None, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(1200)] + [(None, 7, "user", "same.")] * 300
    assert run(spark, rows, block_rows=4) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == {}


def test_all_rows_dropped(spark):
    c = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(c, 0, "user", "Hi.")]) == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_auction_prices_are_shortest_distances():
    rnd = random.Random(4)
    for _ in range(300):
        codes = "".join(rnd.choice("suax") + rnd.choice("kkktd") for _ in range(rnd.randint(0, 12)))
        whole = [(a, b) for a, b in zip(codes[::2], codes[1::2])]
        want = cheapest([({"s": "system", "u": "user", "a": "assistant", "x": "tool"}[a], "") for a, _ in whole], [{"d": "blank", "t": "truncated", "k": None}[b] for _, b in whole])
        cost, parts, _ = Lattice(codes, True).scripts([0])[0]
        assert (cost, "".join(parts)) == want[:2]
        cut = 2 * rnd.randint(0, len(codes) // 2)
        left, right = transfer(codes[:cut], False), transfer(codes[cut:], True)
        assert min(left[k] + right[4 * k] for k in range(4)) == cost < FAR
