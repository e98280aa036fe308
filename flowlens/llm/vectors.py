"""Vector search in blocks: rows dealt to shards, queries to blocks, one search for each (shard, block)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import ship_package, written

SHARD_ROWS = 16_384
BLOCK_QUERIES = 1_024
HIT = "query long, query_id long, row long, vec_id long, score {}"


def usable_rows(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """The written table (row, vec_id, dim, vector) of the vectors that take part, components as doubles.

    Left out: null ids, null or empty vectors, vectors with a null or non-finite component and, with ``nonzero``,
    zero vectors.  Vectors only meet vectors of their own length.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if nonzero:
        fine = fine & F.exists("vector", lambda x: x != 0.0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(F.coalesce(fine, F.lit(False)))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("vector").alias("dim"), "vector"), "vectors")


def _pack(table: pa.Table) -> pa.Table:
    """One row with a whole group: sorted by (vec_id, row), vectors as one binary matrix of doubles."""
    table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    matrix = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
    return pa.table({
        "dim": table.column("dim").slice(0, 1).cast(pa.int32()), "part": table.column("part").slice(0, 1),
        "rows": pa.array([table.column("row").to_numpy().astype("<i8").tobytes()], pa.binary()),
        "ids": pa.array([table.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
        "matrix": pa.array([matrix.tobytes()], pa.binary()),
    })


def _packed(rows: DataFrame, part_rows: int) -> tuple[DataFrame, int]:
    """Groups of about ``part_rows`` rows, packed; and the number of parts (one count reaches the driver)."""
    parts = 1 + rows.count() // part_rows
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    return dealt.groupBy("dim", "part").applyInArrow(lambda t: _pack(t), "dim int, part long, rows binary, ids binary, matrix binary"), parts


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def unpacked(rows: bytes, ids: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(matrix, "<f8").reshape(-1, dim)


def search_blocks(
    rows: DataFrame, is_query: Column, index: Callable, find: Callable, k: int, score: str,
    shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """Top ``k`` of all ``rows`` for each row that ``is_query``: (query_id, rank, vec_id, score).

    ``index(rows, ids, matrix) -> bytes`` builds one shard's index; ``find(index bytes, rows, ids, matrix)`` yields for
    a block of queries their hits in that shard as five arrays (query row, query id, row, vec_id, score), at most
    ``k`` for each query.  Shards and blocks hold a bounded number of rows, so a search task does too.
    """
    ship_package(rows.sparkSession)
    shards, n_shards = _packed(rows, shard_rows)
    blocks, n_blocks = _packed(rows.filter(is_query), block_queries)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                made = index(*unpacked(r["rows"], r["ids"], r["matrix"], r["dim"]))
                yield pa.RecordBatch.from_pydict({"dim": pa.array([r["dim"]], pa.int32()), "part": [r["part"]], "index": pa.array([made], pa.binary())})

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                hits = find(r["index"], *unpacked(r["rows"], r["ids"], r["matrix"], r["dim"]))
                yield pa.RecordBatch.from_arrays([pa.array(h) for h in hits], names=["query", "query_id", "row", "vec_id", "score"])

    indexes = written(shards.mapInArrow(build, "dim int, part long, index binary"), "indexes")
    left = indexes.select(F.col("dim"), F.col("part").alias("shard"), "index", F.explode(_numbers(n_blocks)).alias("block"))
    right = blocks.select(
        F.col("dim").alias("q_dim"), F.col("part").alias("q_block"), "rows", "ids", "matrix",
        F.explode(_numbers(n_shards)).alias("q_shard"),
    )
    pairs = left.hint("merge").join(
        right, (F.col("dim") == F.col("q_dim")) & (F.col("shard") == F.col("q_shard")) & (F.col("block") == F.col("q_block"))
    ).select("index", "rows", "ids", "matrix", "dim")
    hits = pairs.mapInArrow(search, HIT.format(score))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id"), F.col("row"))
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
