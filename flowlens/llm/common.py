"""Helpers shared by the training-data operators: written hand-offs, prefix sums, Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.session import ensure_checkpoint_dir, scratch_dir, ship_package  # noqa: F401

#: Bytes of text that one step inside a Python task handles at a time.
SLICE_BYTES = 4 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and return the table read back (cuts the lineage)."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a frame that :func:`written` returned, once nothing reads them any more."""
    sc = df.sparkSession.sparkContext
    folders = {os.path.dirname(f) for f in df.inputFiles()}
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    for folder in folders:
        if "/flowlens-" in folder and os.path.basename(base) in folder:
            target = sc._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_totals(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], values: dict[str, tuple[Column, str]]) -> DataFrame:
    """Exclusive running totals within ``keys``, ordered by ``bucket`` first and ``order`` inside it.

    ``values``: new column -> (value, "sum" or "bit_xor").  Two levels: one partial aggregate per (keys, bucket) gives
    the buckets' offsets, and rows are only sorted inside their own bucket, so a key with a third of all rows is spread
    over its buckets.
    """
    kinds = {"sum": (F.sum, lambda a, b: a + b), "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}
    rows = df.withColumn("_bucket", bucket)
    for i, (value, _) in enumerate(values.values()):
        rows = rows.withColumn(f"_v{i}", value)
    by_bucket = [*keys, "_bucket"]
    how = [kinds[kind] for _, kind in values.values()]
    totals = rows.groupBy(*by_bucket).agg(*[agg(f"_v{i}").alias(f"_t{i}") for i, (agg, _) in enumerate(how)])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by_bucket)],
        *[F.coalesce(agg(f"_t{i}").over(earlier), F.lit(0)).alias(f"_o{i}") for i, (agg, _) in enumerate(how)],
    )
    inside = Window.partitionBy(*by_bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for i, (agg, _) in enumerate(how):
        rows = rows.withColumn(f"_b{i}", F.coalesce(agg(f"_v{i}").over(inside), F.lit(0)))
    match = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by_bucket)))
    out = rows.join(offsets, match)
    for i, (name, (_, plus)) in enumerate(zip(values, how)):
        out = out.withColumn(name, plus(F.col(f"_o{i}"), F.col(f"_b{i}")))
    helpers = [f"_{x}{i}" for i in range(len(how)) for x in "vob"]
    return out.drop("_bucket", *helpers, *[f"_k{i}" for i in range(len(by_bucket))])


def running_total(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """:func:`running_totals` for one sum."""
    return running_totals(df, keys, bucket, order, {out: (value, "sum")})


def text_slices(batches: Iterable, limit: int = SLICE_BYTES) -> Iterator:
    """Cut Arrow record batches into row ranges that hold about ``limit`` bytes of column 'text' (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0)
        group = (np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64) - 1).clip(0) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            yield batch.slice(int(lo), int(hi - lo))
