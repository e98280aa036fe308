"""Parquet table access (the driver's tables and stage outputs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


# A scan smaller than this is not worth spreading over the cores.
SPREAD_MIN_BYTES = 4 << 20


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Read ``{base_dir}/{name}.parquet``; a missing input surfaces as FileNotFoundError."""
    path = f"{base_dir.rstrip('/')}/{name}.parquet"
    try:
        return spread(spark.read.parquet(path))
    except AnalysisException as exc:  # PATH_NOT_FOUND
        raise FileNotFoundError(path) from exc


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a large scan that yields fewer splits than cores (e.g. one row group).

    A cluster read of many files already has thousands of splits: then this is a no-op.
    """
    sc = df.sparkSession.sparkContext
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= SPREAD_MIN_BYTES and df.rdd.getNumPartitions() < sc.defaultParallelism:
        return df.repartition(sc.defaultParallelism)
    return df


def load_stage(spark: SparkSession, path: str) -> DataFrame:
    """Guarded load of a stage output written by ``sink_table``."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        raise FileNotFoundError(f"stage input missing: {path}") from exc


def sink_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> str:
    """Write a stage output (overwrite).  Parquet between stages, CSV only at the edges."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path
