"""Exact order statistics without one-task groups.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, and a window partitioned only by class sorts the whole class
in one task.  Both break when one group holds a third of the data.  The helpers
here split each group into value-range buckets first:

1. quantiles: a mergeable sketch brackets them, rows below are counted, and only the values inside the brackets are
   ranked; no table that grows with the input is written;
2. running sums (curves, AUC): bucket boundaries per group from ``percentile_approx`` over the distinct points,
   checkpointed so every recomputation sees the same boundaries; bucket totals -> exclusive prefix per group on the
   small bucket table; exact work only inside buckets, which are bounded.

The result is exact; the sketch only decides the partitioning.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import ensure_checkpoint_dir, scratch_dir

DEFAULT_BUCKETS = 1
# Buckets grow with the largest group so that one bucket holds about this many distinct values.
TARGET_PER_BUCKET = 1_000_000
MAX_BUCKETS = 16_384
# Rank error of the bracketing sketch, half width of a bracket in rank, groups that are taken whole.
SKETCH_ACCURACY = 10_000
BRACKET = 3 / SKETCH_ACCURACY
SMALL_GROUP = 2 * SKETCH_ACCURACY
# Up to this many groups the table of brackets is broadcast, so the values meet it where they are read.
BROADCAST_GROUPS = 10_000


def _fixed(df: DataFrame) -> DataFrame:
    """Materialise a small table into the reliable checkpoint folder (stable under recompute)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate that several branches reuse, read it back (lineage cut, columnar)."""
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def value_buckets(vc: DataFrame, group_cols: list[str], value_col: str, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Add bucket id ``_b`` (0..B-1) to a table of distinct values per group.

    Buckets are contiguous, ordered value ranges of roughly equal numbers of
    distinct values.  B is at least ``buckets`` and grows with the largest group
    (about ``TARGET_PER_BUCKET`` distinct values per bucket).
    """
    largest = vc.groupBy(*group_cols).count().agg(F.max("count")).first()[0] or 0  # one scalar
    buckets = int(min(MAX_BUCKETS, max(buckets, -(-largest // TARGET_PER_BUCKET))))
    if buckets == 1:  # every group fits one bucket: no sketch, no boundary table
        return vc.withColumn("_b", F.lit(0))
    probs = [i / buckets for i in range(1, buckets)]
    bounds = _fixed(
        vc.groupBy(*group_cols).agg(F.percentile_approx(F.col(value_col), probs, max(10000, 20 * buckets)).alias("_bounds"))
    )
    v = F.col(value_col)
    return vc.join(bounds, group_cols, "left").withColumn(
        "_b", F.size(F.filter(F.col("_bounds"), lambda x: x < v)).cast("int")
    ).drop("_bounds")


def exact_quantiles(
    long_df: DataFrame,
    group_cols: list[str],
    value_col: str,
    probs: list[float],
    names: list[str],
    buckets: int = DEFAULT_BUCKETS,
    approx: bool = False,
) -> DataFrame:
    """Linear-interpolated quantiles (numpy / ``quantile_cont`` rule) per group.

    Returns ``group_cols + names``; NULL values are ignored; groups without
    values are absent.  ``approx=True`` uses ``percentile_approx`` directly.
    """
    v = F.col(value_col)
    data = long_df.filter(v.isNotNull() & ~F.isnan(v))
    if approx:
        arr = F.percentile_approx(v, probs, 10000)
        out = data.groupBy(*group_cols).agg(arr.alias("_q"))
        return out.select(*group_cols, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])

    return _bracketed(data, group_cols, value_col, probs, names, buckets)


def _bracketed(data: DataFrame, group_cols: list[str], value_col: str, probs: list[float], names: list[str], buckets: int) -> DataFrame:
    """Exact quantiles from three passes; only the values near a quantile are shuffled.

    1. one mergeable sketch per group brackets every quantile (rank error of the sketch: 1 / SKETCH_ACCURACY);
    2. rows below each bracket are counted, and the distinct values inside it are counted by value;
    3. the exact ranks are picked from what lies inside, a small part of a large group.
    """
    v = F.col(value_col)
    edges = [min(1.0, max(0.0, p + side * BRACKET)) for p in probs for side in (-1, 1)]
    sketch = data.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.min(v).alias("_min"), F.max(v).alias("_max"), F.percentile_approx(v, edges, SKETCH_ACCURACY).alias("_e")
    )
    whole = F.col("_n") < F.lit(SMALL_GROUP)  # every value of a small group is inside
    lows = [F.when(whole | F.lit(p <= BRACKET), F.col("_min")).otherwise(F.col("_e")[2 * i]) for i, p in enumerate(probs)]
    highs = [F.when(whole | F.lit(p >= 1 - BRACKET), F.col("_max")).otherwise(F.col("_e")[2 * i + 1]) for i, p in enumerate(probs)]
    brackets = _fixed(sketch.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group_cols)], "_n", *[x.alias(f"_lo{i}") for i, x in enumerate(lows)],
                                    *[x.alias(f"_hi{i}") for i, x in enumerate(highs)]))
    match = reduce(and_, (F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group_cols))) if group_cols else F.lit(True)
    few = brackets.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    near = data.select(*group_cols, v.alias("_v")).join(F.broadcast(brackets) if few else brackets, match)
    below = near.groupBy(*group_cols).agg(F.max("_n").alias("_n"), *[F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_b{i}") for i in range(len(probs))])
    marks = F.array(*[F.when(F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")), F.lit(i)) for i in range(len(probs))])
    inside = near.select(*group_cols, "_v", F.explode(F.array_compact(marks)).alias("_i")).groupBy(*group_cols, "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = ordered_prefix(inside, [*group_cols, "_i"], "_v", ["_c"], buckets)
    ranks = below.select(*group_cols, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_i"), (F.lit(p) * (F.col("_n") - 1)).alias("_pos"), F.col(f"_b{i}").alias("_below")) for i, p in enumerate(probs)
    ])).alias("_t")).select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group_cols)], F.col("_t._i").alias("_ti"), F.col("_t._pos").alias("_pos"), F.col("_t._below").alias("_below"))
    at = ranked.join(ranks, match & (F.col("_i") == F.col("_ti")))
    place = lambda r: (r - F.col("_below") >= F.col("_c_before")) & (r - F.col("_below") < F.col("_c_upto"))
    picked = at.groupBy(*group_cols, "_i").agg(
        F.max(F.when(place(F.floor("_pos")), F.col("_v"))).alias("_lo"), F.max(F.when(place(F.ceil("_pos")), F.col("_v"))).alias("_hi"), F.max("_pos").alias("_pos")
    )
    frac = F.col("_pos") - F.floor(F.col("_pos"))
    value = F.when(frac == 0, F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac)
    return picked.withColumn("_q", value).groupBy(*group_cols).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)])


def ordered_prefix(
    df: DataFrame,
    group_cols: list[str],
    order_col: str,
    sum_cols: list[str],
    buckets: int = DEFAULT_BUCKETS,
) -> DataFrame:
    """Exclusive and inclusive running sums of ``sum_cols`` in ``order_col`` order per group.

    ``df`` must have one row per (group, order value) (aggregate first).  Adds
    ``{s}_before`` (sum over strictly smaller order values) and ``{s}_upto``.
    """
    df = _written(df, "ordered-points")
    vcb = value_buckets(df, group_cols, order_col, buckets)
    bt = vcb.groupBy(*group_cols, "_b").agg(*[F.sum(s).alias(f"_bt_{s}") for s in sum_cols])
    wb = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select(*group_cols, "_b", *[F.coalesce(F.sum(f"_bt_{s}").over(wb), F.lit(0)).alias(f"_off_{s}") for s in sum_cols])
    keys = group_cols + ["_b"]
    wv = Window.partitionBy(*keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = vcb.join(bt, keys, "left")
    for s in sum_cols:
        out = out.withColumn(f"{s}_upto", F.col(f"_off_{s}") + F.sum(s).over(wv)).withColumn(
            f"{s}_before", F.col(f"{s}_upto") - F.col(s)
        )
    return out.drop("_b", *[f"_off_{s}" for s in sum_cols])


# hash_rank's (group, bucket) windows hold at most about this many rows.
ROWS_PER_HASH_BUCKET = 250_000


def hash_prefix_chars(rows: int) -> int:
    """Hex digits of the hash used as bucket: 16^d buckets of at most ~250,000 rows each (1 <= d <= 6)."""
    d = 1
    while d < 6 and rows / (16**d) > ROWS_PER_HASH_BUCKET:
        d += 1
    return d


def hash_rank(df: DataFrame, group_cols: list[str], hash_col: str, prefix_chars: int | None = None) -> DataFrame:
    """0-based rank ``_rank`` of each row within its group in ``hash_col`` (hex md5) order.

    The hash is uniform, so its leading hex digits are an exact range bucket:
    no sketch needed.  Rows are shuffled by (group, bucket), never by group alone;
    the number of digits follows the row count (so a hot group still gets small buckets).
    The rows and their hash (as bytes, which order like the hex digits) are written once:
    hashing a row costs more than reading it back, and both passes need it.
    Also adds ``_n`` (group size).
    """
    kept = _written(df.withColumn("_hk", F.unhex(hash_col)).drop(hash_col), "hashed")
    data = kept.withColumn(hash_col, F.lower(F.hex("_hk")))
    prefix_chars = prefix_chars or hash_prefix_chars(kept.count())
    b = F.conv(F.hex(F.substring(F.col("_hk"), 1, (prefix_chars + 1) // 2)), 16, 10).cast("int")
    data = data.withColumn("_hb", b if prefix_chars % 2 == 0 else F.shiftright(b, 4))
    bt = data.groupBy(*group_cols, "_hb").agg(F.count(F.lit(1)).alias("_bc"))
    wb = Window.partitionBy(*group_cols).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select(
        *group_cols,
        "_hb",
        F.coalesce(F.sum("_bc").over(wb), F.lit(0)).alias("_off"),
        F.sum("_bc").over(Window.partitionBy(*group_cols)).alias("_n"),
    )
    keys = group_cols + ["_hb"]
    wr = Window.partitionBy(*keys).orderBy("_hk")
    out = data.join(bt, keys, "left").withColumn("_rank", (F.col("_off") + F.row_number().over(wr) - 1).cast("bigint"))
    return out.drop("_hb", "_off", "_hk")

