"""Stage outputs written once per session and read back (the hand-off between stages).

A stage (cleaned flows, split + encoded flows) feeds many queries.  Writing it as
Parquet under the shared checkpoint folder cuts the lineage: later queries read
it with column pruning and predicate pushdown instead of recomputing the chain,
and a lost executor only recomputes from the written table.  ``reset()`` drops
the registry so that a timed run includes the full chain again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.session import scratch_dir

_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}
_CACHES: list[dict] = []


def resettable(cache: dict) -> dict:
    """A memo of a plan module (fitted models, raw files) that :func:`reset` empties too."""
    _CACHES.append(cache)
    return cache


def stage(spark: SparkSession, name: str, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _WRITTEN:
        path = scratch_dir(spark, f"stage-{name}")
        build().write.mode("overwrite").parquet(path)
        _WRITTEN[key] = spark.read.parquet(path)
    return _WRITTEN[key]


def reset() -> None:
    _WRITTEN.clear()
    for cache in _CACHES:
        cache.clear()
