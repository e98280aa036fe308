"""Scoring as a micro-batch stream over arriving CSV files.

``readStream`` (file source, fixed schema) -> the batch scoring transform -> one ``foreachBatch`` that writes each
micro-batch's predictions and counts into a folder of its epoch, so that each file is read and scored once and a
replayed epoch replaces its own output.  ``availableNow`` processes what is there and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.exprs import argmax_index
from flowlens.operators import score as SC
from flowlens.session import scratch_dir


def _score(df: DataFrame, expected: list[str], probability: Callable[[DataFrame], Column], mapping: DataFrame) -> DataFrame:
    x = SC.impute_zero(SC.select_features_ordered(df, expected, keep=["source_file"]), expected)
    p = x.withColumn("_p", probability(x))
    p = p.withColumn("pred_idx", argmax_index(F.col("_p"))).withColumn("confidence", F.bround(F.array_max("_p"), SC.CONFIDENCE_DIGITS))
    return SC.join_label_map(p, mapping).drop("_p")


def score_stream(
    spark: SparkSession,
    in_dir: str,
    schema: T.StructType,
    expected: list[str],
    probability: Callable[[DataFrame], Column],
    mapping: DataFrame,
    out_dir: str | None = None,
    max_files_per_trigger: int | None = None,
) -> tuple[str, str]:
    """Run the stream to completion over the files present; returns (predictions path, summary path)."""
    out_dir = out_dir or scratch_dir(spark, "stream")
    src = (
        spark.readStream.schema(schema)
        .option("header", True)
        .options(**({"maxFilesPerTrigger": max_files_per_trigger} if max_files_per_trigger else {}))
        .csv(in_dir)
        .withColumn("source_file", F.input_file_name())
    )
    scored = _score(src, expected, probability, mapping)
    pred_path, summary_path = f"{out_dir}/predictions", f"{out_dir}/summary"

    def write(batch: DataFrame, epoch: int) -> None:
        """Score a micro-batch once; a replayed epoch overwrites its own folder only."""
        part = f"{pred_path}/epoch={epoch}"
        batch.write.mode("overwrite").parquet(part)
        SC.prediction_summary(spark.read.parquet(part)).write.mode("overwrite").parquet(f"{out_dir}/counts/epoch={epoch}")

    query = scored.writeStream.foreachBatch(write).option("checkpointLocation", f"{out_dir}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    counts = spark.read.parquet(f"{out_dir}/counts")
    names = ("total_samples", "predicted_attacks", "predicted_benign")
    counts.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names]).write.mode("overwrite").parquet(summary_path)
    return pred_path, summary_path
