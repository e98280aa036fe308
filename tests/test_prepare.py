"""Split, sample and fold properties (FIXTURES D e_split)."""

from pyspark.sql import functions as F

from flowlens.operators import prepare as P


def _classes(spark):
    rows = []
    for label, n in (("one", 1), ("two", 2), ("three", 3), ("many", 100)):
        rows += [(label, float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "Label string, x double")


def test_split_exact_disjoint_complete_deterministic(spark):
    df = _classes(spark)
    s1 = P.stratified_split(df)
    counts = {(r["Label"], r["split"]): r["count"] for r in s1.groupBy("Label", "split").count().collect()}
    assert counts[("many", "train")] == 70 and counts[("many", "valid")] == 15 and counts[("many", "test")] == 15
    assert counts[("one", "test")] == 1
    assert s1.count() == df.count()
    assert s1.select("Label", "x").distinct().count() == df.count()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    s2 = P.stratified_split(df)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(s1.collect()) == sorted(s2.collect())


def test_sample_quotas_sum_and_proportions(spark):
    df = _classes(spark)
    s = P.stratified_sample(df, 50)
    assert s.count() == 50
    per = {r["Label"]: r["count"] for r in s.groupBy("Label").count().collect()}
    assert abs(per["many"] - 50 * 100 / 106) <= 1
    assert P.stratified_sample(df, 10_000).count() == df.count()


def test_folds_balanced(spark):
    df = _classes(spark)
    f = P.kfold_stratified(df, k=3)
    sizes = [r["count"] for r in f.filter(F.col("Label") == "many").groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 100


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 3 + [(2,)] * 1, "label_idx long")
    w = {r["label_idx"]: r["weight"] for r in P.class_weights(df).collect()}
    # sum over classes of weight * n_c equals N
    assert abs(w[0] * 6 + w[1] * 3 + w[2] * 1 - 10) < 1e-12
    assert abs(w[2] - 10 / 3) < 1e-12


def test_label_mapping_code_point_order(spark):
    df = spark.createDataFrame([("DoS slowloris",), ("DoS Slowhttptest",), ("BENIGN",)], "Label string")
    m = [r["label"] for r in P.label_mapping(df).orderBy("idx").collect()]
    assert m == ["BENIGN", "DoS Slowhttptest", "DoS slowloris"]
