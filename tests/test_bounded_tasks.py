"""What one task holds does not grow with the table."""

from pyspark.sql import functions as F

from flowlens.operators import ordered as O
from flowlens.operators import stats as S
from flowlens.operators import train as T


def test_training_rows_are_dealt_by_their_number(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    assert T.fit_partitions(cores * T.FIT_ROWS, cores) is None
    assert T.fit_partitions(1000 * T.FIT_ROWS, cores) == 1000
    monkeypatch.setattr(T, "FIT_ROWS", 10)
    dealt = T.spread_rows(spark.range(200).coalesce(1))
    assert dealt.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] <= 20
    assert dealt.distinct().count() == 200


def test_in_bag_bits_are_the_rows_with_a_weight(spark):
    keys = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("k"))
    bits = keys.select(T.in_bag_bits(F.col("k"), 40).alias("b"), *[(T.poisson_weight(F.col("k"), t) > 0).alias(f"t{t}") for t in (0, 31, 32, 39)])
    for t in (0, 31, 32, 39):
        assert bits.filter(~T._out_of_bag(F.col("b"), t) != F.col(f"t{t}")).count() == 0


def test_hash_buckets_follow_the_rows():
    assert [O.hash_prefix_chars(n) for n in (0, 4_000_000, 5_000_000, 200_000_000)] == [1, 1, 2, 3]


def test_brackets_and_fences_are_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select((F.col("id") % 10).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
        rows = {r["feature_name"]: r for r in S.outliers_iqr(df, ["x", "y"]).collect()}
        assert rows["y"]["q1"] == 249.75 and rows["x"]["outlier_count"] == 0
        plan = S.boxplot_stats(df, ["x", "y"])._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
