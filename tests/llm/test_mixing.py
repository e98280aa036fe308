import random
from collections import Counter

from pyspark.sql import functions as F

from flowlens.llm import mixing
from flowlens.llm.mixing import mix_sources, mixed_rows, slot_schedule, van_der_corput

SCHEMA = "doc_id long, text string, source string, size string, key long, row string"


def targets_by_rounds(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)


def sample():
    rnd = random.Random(2)
    rows = []
    for i in range(300):
        source = rnd.choice(["a", "a", "a", "a", "b", "c", "Z", "é", None, "empty"])
        words = 0 if source == "empty" else rnd.choice([0, 1, 5, 80, 900])
        rows.append((i, " ".join("x%d" % rnd.randrange(50) for _ in range(words)), source))
    return [*rows, (7, rows[7][1], rows[7][2]), (400, None, "b"), (None, "one two", "c"), (401, "\t \n", "a"), (402, "w " * 30000, "Z")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "z", 5, "r") for i, t, s in rows], SCHEMA).repartition(4)


def test_targets_and_takes(spark):
    rows = sample()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets_by_rounds(sizes)
    documents, takes = mix_sources(frame(spark, rows), block=64)
    taken = {r["row"]: r["n"] for r in takes.groupBy("row").agg(F.sum("words").alias("n")).collect()}
    got = documents.collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((i or -1, len((t or "").split())) for i, t, _ in rows)
    by_target = Counter()
    for r in got:
        n = taken.get(r["row"], 0)
        assert 0 <= n <= 2 * r["size"]
        by_target[(r["source_size"], round(r["target"], 6))] += n
    assert by_target == {(sizes[s], round(t, 6)): int(t + 0.5) for s, t in want.items()}
    again, takes2 = mix_sources(frame(spark, rows).repartition(2), block=64)
    total = lambda d, t: sorted((r["doc_id"] or -1, r["size"], r["n"] or 0) for r in d.join(t.groupBy("row").agg(F.sum("words").alias("n")), "row", "left").collect())
    assert total(documents, takes) == total(again, takes2)


def test_schedule_stays_close_to_the_shares(spark):
    targets = spark.createDataFrame([("=a", 640_000, 700_000.0), ("=b", 640_000, 200_000.0), ("=c", 64_000, 100_000.0)], "key string, source_size long, target double")
    slots = sorted((r["slot"], r["key"]) for r in slot_schedule(targets, 64).collect())
    seen, share = Counter(), {"=a": 0.7, "=b": 0.2, "=c": 0.1}
    for n, (_, key) in enumerate(slots, 1):
        seen[key] += 1
        assert all(abs(seen[k] - n * share[k]) < 12 for k in share)
    points = [r[0] for r in spark.range(8).select(van_der_corput(F.col("id"))).collect()]
    assert points == [0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875]


def test_mixed_rows_and_empty(spark):
    rows = [(i, "a b c d e\nf g h i j", s) for i, s in enumerate("xxxxyyz")] + [(9, None, None)]
    out = mixed_rows(frame(spark, rows), block=4)
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len(r["text"].split())
        assert "a b c d e\nf g h i j".split()[: len(r["text"].split())] == r["text"].split()
    want = {s: int(t + 0.5) for s, t in targets_by_rounds({"x": 40, "y": 20, "z": 10, None: 0}).items() if t}
    assert words == want
    empty = frame(spark, rows).limit(0)
    documents, takes = mix_sources(empty)
    assert documents.count() == 0 and takes.count() == 0 and mixed_rows(empty).count() == 0


def farthest(parts, share):
    """How far, in words, any beginning of a list of (source, words) is from the sources' shares."""
    seen, worst = Counter(), 0.0
    for source, n in parts:
        seen[source] += n
        total = sum(seen.values())
        worst = max([worst, *(abs(seen[s] - total * share[s]) for s in share)])
    return worst


def test_order_of_the_mix_comes_from_the_schedule(spark, monkeypatch):
    rows = [(i, "w " * 16, "abc"[i % 3]) for i in range(900)]
    want = targets_by_rounds({"a": 4800, "b": 4800, "c": 4800})
    share = {s: t / sum(want.values()) for s, t in want.items()}

    def order():
        out = mixed_rows(frame(spark, rows), block=16)
        return [(r["source"], len(r["text"].split())) for r in out.collect()]

    def by_slot():
        documents, takes = mix_sources(frame(spark, rows), block=16)
        took = takes.join(documents.withColumn("source", F.element_at(F.array(*map(F.lit, "abc")), (F.col("doc_id") % 3 + 1).cast("int"))), "row")
        return [(r["source"], r["words"]) for r in took.orderBy("first_slot", "epoch").collect()]

    assert farthest(order(), share) < 12 * 16 and farthest(by_slot(), share) < 12 * 16
    monkeypatch.setattr(mixing, "van_der_corput", lambda t: F.lit(0.0))
    assert farthest(order(), share) > 100 * 16 and farthest(by_slot(), share) > 100 * 16
