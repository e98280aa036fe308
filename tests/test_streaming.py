"""Streaming scoring returns the same predictions as batch scoring over the same rows."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators import score as SC
from flowlens.plans.fixtures import CLEAN_FEATURES, LABEL
from flowlens.plans.q_eval import classes, rule_probability
from flowlens.plans.q_prepare import split_part
from flowlens.session import scratch_dir
from flowlens.streaming.score_stream import score_stream

from conftest import SF_SMALL


def test_stream_equals_batch(spark):
    rows = split_part(spark, SF_SMALL, "test")
    in_dir = scratch_dir(spark, "test-stream-in")
    rows.repartition(3).write.option("header", True).csv(in_dir)
    schema = T.StructType([T.StructField(LABEL, T.StringType())] + [T.StructField(f, T.DoubleType()) for f in CLEAN_FEATURES])
    cls = classes(spark, SF_SMALL)
    pred_path, summary_path = score_stream(spark, in_dir, schema, CLEAN_FEATURES, lambda x: rule_probability("A"), cls)
    streamed = spark.read.parquet(pred_path).select("prediction", "confidence", *CLEAN_FEATURES)
    batch = SC.score_batch(SC.row_numbers(rows), CLEAN_FEATURES, lambda x: rule_probability("A"), cls, row_col="row")
    batch_rows = batch.join(SC.row_numbers(rows), "row").select("prediction", "confidence", *CLEAN_FEATURES)
    assert sorted(streamed.collect()) == sorted(batch_rows.collect())
    summary = spark.read.parquet(summary_path).first()
    assert summary["total_samples"] == rows.count()
    assert summary["predicted_benign"] == streamed.filter(F.upper("prediction") == "BENIGN").count()
