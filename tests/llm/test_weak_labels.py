import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlens.llm import quality

D = "/root/testdata/sf0.1"


def test_estimates_accuracies_without_labels():
    rng = np.random.default_rng(3)
    bad = rng.random(20_000) < 0.2
    finds, slips = np.array([0.9, 0.7, 0.8, 0.6]), np.array([0.005, 0.02, 0.01, 0.03])
    rejects = rng.random((20_000, 4)) < np.where(bad[:, None], finds, slips)
    votes = np.where(rng.random((20_000, 4)) < [0.9, 0.8, 0.5, 0.9], rejects + 1, quality.ABSTAIN)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    tables, posterior = quality.estimate_labellers(patterns, counts.astype(float))
    for j in range(4):
        assert abs(tables[j][1][1] - finds[j]) < 0.08 and abs(tables[j][0][1] - slips[j]) < 0.02
    truth = np.array([bad[(votes == p).all(axis=1)].mean() for p in patterns])
    assert np.average(np.abs(truth - posterior), weights=counts) < 0.03


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    model = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    held = labels.filter("doc_id % 2 = 1").withColumn("bad", (F.col("quality") == 0) | (F.col("toxic") == 1))
    rows = quality.score(docs, model).join(held, "doc_id").groupBy("bad", "rejected").count().collect()
    n = {(r["bad"], r["rejected"]): r["count"] for r in rows}
    assert n[(True, True)] / (n[(True, True)] + n.get((True, False), 0)) > 0.97
    assert n.get((False, True), 0) / n[(False, False)] < 0.01


def test_held_out_accuracy_with_copies_of_one_toxic_document(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    learn = labels.filter("doc_id % 2 = 0")
    copied = docs.join(learn.filter("toxic = 1"), "doc_id").orderBy(F.size(F.split("text", " ")).desc(), "doc_id").first()["text"]
    third = learn.filter("toxic = 1 and pmod(xxhash64(doc_id), 3) = 0").select(F.col("doc_id").alias("copy_id"))
    docs = docs.join(F.broadcast(third), F.col("doc_id") == F.col("copy_id"), "left")
    docs = docs.withColumn("text", F.when(F.col("copy_id").isNotNull(), F.lit(copied)).otherwise(F.col("text"))).drop("copy_id")
    model = quality.fit(docs, learn)
    held = labels.filter("doc_id % 2 = 1").withColumn("bad", (F.col("quality") == 0) | (F.col("toxic") == 1))
    scored = quality.score(docs, model).join(held, "doc_id").select("bad", "rejected", "text").toArrow()
    bad, rejected = scored["bad"].to_numpy(), scored["rejected"].to_numpy()
    listed = quality._Documents(scored["text"].combine_chunks(), model.lexicon).votes()[:, -1] == quality.REJECT
    # the other 144 toxic texts alone teach a recall of 0.956; 0.958 here, and 0.916 when every copy counted
    assert rejected[bad].mean() > 0.94 and rejected[~bad].mean() < 0.01 and listed[~bad].mean() < 0.01


def test_list_merges_beginnings_before_it_is_cut(spark, monkeypatch):
    toxic = [f"zorkblatter{k} the x{k}" + (" quuxly" if k % 2 else "") for k in range(40)]
    clean = [f"the cat sat on mat{k}" for k in range(400)]
    df = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(440)], "doc_id long, toxic int")
    monkeypatch.setattr(quality, "MOST_WORDS", 2)
    assert quality.toxic_word_list(df, labels) == {"zork", "quux"}


def test_edge_rows(spark):
    schema = "doc_id long, text string, rejected string, reject_score string, x int"
    rows = [(1, None), (2, ""), (None, "the cat and the dog"), (3, "the cat is on a mat"), (3, "the cat is on a mat"), (4, " \n\t "), (5, "word " * 50_000), (6, "X!! " * 90)]
    df = spark.createDataFrame([(i, t, "r", "s", 7) for i, t in rows], schema).repartition(2)
    out = quality.classify(df, None)
    assert out.columns == ["doc_id", "text", "x", "reject_score", "rejected"] and out.count() == len(rows)
    got = {r["doc_id"]: r["rejected"] for r in out.collect()}
    assert not got[1] and not got[2] and not got[3] and got[5] and got[6]
    empty = df.limit(0)
    assert quality.classify(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_votes_of_empty_batch():
    assert quality._Documents(pa.array([None, ""], pa.string())).votes().tolist() == [[0] * 9] * 2


def test_null_ids_are_not_rejected_whole(spark):
    rows = [(None, f"plain words of document {i} that say nothing bad and go on for a while like any other text would.") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1, 100):
        assert quality.score(docs, quality.fit(docs, None, fit_documents=most)).filter("rejected").count() < 40
