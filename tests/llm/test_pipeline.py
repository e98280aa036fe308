from collections import Counter

from pyspark.sql import functions as F
from tests_llm_brute import simhash_rows

import corpus_pipeline

D = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "substring dedup", "mixing sources to target weights", "best-fit packing"]
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    before = {r["doc_id"]: r for r in docs.collect()}

    good = corpus_pipeline.quality_stage(spark, docs, D).cache()
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    clean = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    junk = [i for i, r in labels.items() if r["quality"] == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean) and sum(i in kept for i in junk) <= 0.1 * len(junk)

    single = corpus_pipeline.near_duplicate_stage(spark, good, D).cache()
    groups = simhash_rows([(i, before[i]["text"]) for i in sorted(kept)])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, (_, c) in groups.items() if c == i)

    cut = corpus_pipeline.repeated_passage_stage(spark, single, D).cache()
    seen: dict[tuple, int] = {}
    rows = sorted(single.collect(), key=lambda r: r["doc_id"])
    after = {r["doc_id"]: r for r in cut.collect()}
    assert len(after) == len(rows) and cut.columns == docs.columns
    for r in rows:
        words = r["text"].split()
        gone = set()
        for k in range(len(words) - 12):
            if seen.setdefault(tuple(words[k : k + 13]), r["doc_id"]) < r["doc_id"]:
                gone.update(range(k, k + 13))
        want = " ".join(w for k, w in enumerate(words) if k not in gone) if gone else r["text"]
        assert after[r["doc_id"]]["text"] == want and after[r["doc_id"]]["n_chars"] == (len(want) if gone else r["n_chars"])

    mix = corpus_pipeline.mixing_stage(spark, cut, D).cache()
    assert mix.columns == docs.columns
    have = {i: len(r["text"].split()) for i, r in after.items()}
    taken = Counter()
    for r in mix.collect():
        taken[r["doc_id"]] += len(r["text"].split())
        assert after[r["doc_id"]]["text"].split()[: len(r["text"].split())] == r["text"].split()
    assert all(n <= 2 * have[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(have.values())) <= 25

    packed = corpus_pipeline.packing_stage(spark, mix, D).cache()
    used = Counter()
    for r in sorted(packed.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096 and len(used) <= 2 + sum(used.values()) // 4096

    whole = corpus_pipeline.run(spark, D)
    total = lambda df: df.agg(F.count("*"), F.sum("length"), F.countDistinct("doc_id")).first()
    assert total(whole) == total(packed)


def test_near_duplicates_with_null_and_shared_ids(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").select("text").limit(60).collect()]
    alone = [i for i, (_, c) in simhash_rows(list(enumerate(texts))).items() if sum(c == d for _, d in simhash_rows(list(enumerate(texts))).values()) == 1]
    a, b, c, d, e, f, *_ = [texts[i] for i in alone]
    rows = [(None, a), (None, b), (None, c), (None, c), (1, d), (7, d), (7, e), (7, f), (3, f), (3, f), (None, d)]
    df = docs.select("doc_id", "text").limit(0).union(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    df = df.select(*[F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in docs.dtypes])
    got = corpus_pipeline.near_duplicate_stage(spark, df, D)
    assert got.columns == docs.columns
    want = [(None, a), (None, b), (None, c), (1, d), (7, e), (3, f)]
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(want)


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, D)
        assert docs.count() == 0
    assert corpus_pipeline.packing_stage(spark, docs, D).count() == 0
