"""Distributed statistics: describe, correlation, outliers, skewness, histogram, box plot.

Per-feature work runs on the long ``(feature_name, value)`` form so that one
shuffle keyed by feature serves every column; all aggregates are partial
(map-side) and quantiles are exact without one-task groups (see ``ordered``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.exprs import as_missing, c, numeric_columns, pct_guard
from flowlens.operators.ordered import _written, exact_quantiles
from flowlens.session import ship_package

# Fixed values that must equal the reference.
CORR_THRESHOLD = 0.90
IQR_FACTOR = 1.5
SKEW_SYMMETRIC = 0.5
SKEW_MODERATE = 1.0
HIST_BINS = 50
LOG_SCALE_RATIO = 1000
REPRESENTATIVE = ["Flow Duration", "Total Fwd Packets", "Fwd Packet Length Max", "Bwd Packet Length Mean"]


def long_form(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(feature_name, value)`` rows, NaN as NULL (rows with NULL kept)."""
    wide = df.select(*[as_missing(c(n).cast("double")).alias(n) for n in cols])
    return wide.unpivot([], [c(n) for n in cols], "feature_name", "value")


def _features(df: DataFrame, target_col: str | None, cols: list[str] | None) -> list[str]:
    return cols or numeric_columns(df, exclude=(target_col,) if target_col else ())


def describe_numeric(df: DataFrame, target_col: str | None = "Label", cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """mean, std (sample), min, 25%, median, 75%, max per numeric feature (NULL ignored)."""
    feats = _features(df, target_col, cols)
    lf = long_form(df, feats)
    wide = df.select(*[as_missing(c(n).cast("double")).alias(n) for n in feats])
    rows = wide.agg(*[F.struct(F.lit(n).alias("feature_name"), F.avg(c(n)).alias("mean"), F.stddev_samp(c(n)).alias("std"), F.min(c(n)).alias("min"),
                               F.max(c(n)).alias("max"), F.count(c(n)).alias("_n")).alias(f"f{i}") for i, n in enumerate(feats)])
    moments = rows.select(F.inline(F.array(*[f"f{i}" for i in range(len(feats))]))).filter("_n > 0").drop("_n")
    qs = exact_quantiles(lf, ["feature_name"], "value", [0.25, 0.5, 0.75], ["p25", "median", "p75"], approx=approx)
    return moments.join(qs, "feature_name", "left").select("feature_name", "mean", "std", "min", "p25", "median", "p75", "max")


def corr_matrix(df: DataFrame, target_col: str | None = "Label", cols: list[str] | None = None) -> DataFrame:
    """Pearson matrix as long rows ``(feature_1, feature_2, correlation)``, complete by pairs.

    NaN and infinite cells are missing.  A pair's correlation uses the rows that have both values; it is NULL with
    fewer than two such rows or if either value does not vary over them.  Columns are shifted by their mean and scaled by their
    deviation first, so co-moments of large, narrow values keep their digits; each task multiplies its batches into P x P
    matrices of co-moments and the tasks' matrices are added up by pair.
    """
    feats = _features(df, target_col, cols)
    spark = df.sparkSession
    wide = df.select(*[c(n).cast("double").alias(n) for n in feats])
    wide = wide.select(*[F.when(~F.isnan(c(n)) & (F.abs(c(n)) < F.lit(float("inf"))), c(n)).alias(n) for n in feats])
    ship_package(spark)
    stats = wide.agg(
        *[F.avg(c(n)).alias(f"m{i}") for i, n in enumerate(feats)], *[F.stddev_pop(c(n)).alias(f"s{i}") for i, n in enumerate(feats)]
    ).first()
    shift = [stats[f"m{i}"] or 0.0 for i in range(len(feats))]
    scale = [stats[f"s{i}"] or 1.0 for i in range(len(feats))]
    sums = wide.mapInArrow(comoment_rows(shift, scale), "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    total = sums.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cxy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    # after shifting and scaling, rounding leaves about 1e-16 of a unit per row; less than that is no variation
    varies = (F.col("n") >= 2) & (vx > F.col("n") * 1e-15) & (vy > F.col("n") * 1e-15)
    r = F.when(varies, F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cxy / F.sqrt(vx * vy)))))
    name = lambda k: F.element_at(F.array(*[F.lit(n) for n in feats]), F.col(k) + 1)
    return total.select(name("i").alias("feature_1"), name("j").alias("feature_2"), r.alias("correlation"))


def comoment_rows(shift: list[float], scale: list[float]):
    """Arrow batches of P columns -> one row per pair of columns and task with the sums over rows that have both values."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        p = len(shift)
        kinds = {k: np.zeros((p, p)) for k in ("n", "sx", "sxx", "sxy")}
        for batch in batches:
            x = np.column_stack([col.to_numpy(zero_copy_only=False).astype(float) for col in batch.columns])
            there = ~np.isnan(x)
            x = np.where(there, (x - np.array(shift)) / np.array(scale), 0.0)
            m = there.astype(float)
            kinds["n"] += m.T @ m
            kinds["sx"] += x.T @ m
            kinds["sxx"] += (x * x).T @ m
            kinds["sxy"] += x.T @ x
        i, j = (a.ravel() for a in np.indices((p, p)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(a.ravel()) for a in (
                kinds["n"], kinds["sx"], kinds["sx"].T, kinds["sxx"], kinds["sxx"].T, kinds["sxy"]))],
            names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"],
        )

    return run


def corr_pairs(df: DataFrame, target_col: str | None = "Label", cols: list[str] | None = None, threshold: float = CORR_THRESHOLD) -> DataFrame:
    """Upper-triangle pairs with ``|r| > threshold`` (strict), sorted by ``|r|`` descending."""
    feats = _features(df, target_col, cols)
    order = {n: i for i, n in enumerate(feats)}
    pos = F.create_map(*[x for n, i in order.items() for x in (F.lit(n), F.lit(i))])
    m = corr_matrix(df, target_col, feats)
    return (
        m.filter(pos[F.col("feature_1")] < pos[F.col("feature_2")])
        .withColumn("abs_correlation", F.abs("correlation"))
        .filter(F.col("abs_correlation") > threshold)
        .orderBy(F.col("abs_correlation").desc(), "feature_1", "feature_2")
    )


def outliers_iqr(df: DataFrame, features: list[str], factor: float = IQR_FACTOR) -> DataFrame:
    """q1, q3, iqr, fences and the strict outside count / share per feature.

    Absent and non-numeric features are skipped.  Pass 1: exact quartiles.
    Pass 2: the long rows join the P-row fence table (broadcast) and count
    partially per task.
    """
    numeric = set(numeric_columns(df))
    feats = [f for f in features if f in numeric]
    lf = long_form(df, feats)
    qs = exact_quantiles(lf, ["feature_name"], "value", [0.25, 0.75], ["q1", "q3"])
    fences = _written(  # P rows, used by both the count pass and the output
        qs.withColumn("iqr", F.col("q3") - F.col("q1"))
        .withColumn("lower_bound", F.col("q1") - F.lit(factor) * F.col("iqr"))
        .withColumn("upper_bound", F.col("q3") + F.lit(factor) * F.col("iqr")),
        "fences",
    )
    v = F.col("value")
    counts = lf.join(F.broadcast(fences.select("feature_name", "lower_bound", "upper_bound")), "feature_name").groupBy("feature_name").agg(
        F.count_if((v < F.col("lower_bound")) | (v > F.col("upper_bound"))).cast("bigint").alias("outlier_count"),
        F.count(F.lit(1)).cast("bigint").alias("_n"),
    )
    return fences.join(counts, "feature_name").select(
        "feature_name",
        "q1",
        "q3",
        "iqr",
        "lower_bound",
        "upper_bound",
        "outlier_count",
        pct_guard(F.col("outlier_count"), F.col("_n")).alias("outlier_percentage"),
    )


def skewness_class(df: DataFrame, target_col: str | None = "Label", cols: list[str] | None = None) -> DataFrame:
    """Bias-corrected skewness G1 (0.0 when std is 0) and its class, sorted by ``|skew|``."""
    feats = _features(df, target_col, cols)
    lf = long_form(df, feats).filter(F.col("value").isNotNull())
    n = F.count("value").cast("double")
    g1 = F.skewness("value")
    corrected = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    agg = lf.groupBy("feature_name").agg(
        F.when(F.stddev_samp("value") == 0, F.lit(0.0)).when(n >= 3, corrected).alias("skewness")
    )
    a = F.abs("skewness")
    return (
        agg.withColumn("abs_skewness", a)
        .withColumn(
            "classification",
            F.when(a <= SKEW_SYMMETRIC, F.lit("Symmetric"))
            .when(a <= SKEW_MODERATE, F.lit("Moderately Skewed"))
            .otherwise(F.lit("Highly Skewed")),
        )
        .orderBy(F.col("abs_skewness").desc_nulls_first(), "feature_name")
    )


def skew_counts(skew: DataFrame) -> DataFrame:
    return skew.groupBy("classification").agg(F.count(F.lit(1)).cast("bigint").alias("feature_count"))


def topk_skew(skew: DataFrame, k: int = 10) -> DataFrame:
    """The k most skewed features (P-row input)."""
    return skew.orderBy(F.col("abs_skewness").desc(), "feature_name").limit(k)


def representative_features(df: DataFrame, target_col: str | None = "Label") -> list[str]:
    """The four named features when all are present, else the first four numeric ones."""
    feats = _features(df, target_col, None)
    rep = [f for f in REPRESENTATIVE if f in feats]
    return rep if len(rep) >= 4 else feats[:4]


def rep_feature_summary(df: DataFrame, target_col: str | None = "Label") -> DataFrame:
    """min, max, mean, std and distinct count of the representative features."""
    feats = representative_features(df, target_col)
    lf = long_form(df, feats).filter(F.col("value").isNotNull())
    return lf.groupBy("feature_name").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.count_distinct("value").cast("bigint").alias("unique_values"),
    )


def histogram(df: DataFrame, features: list[str], bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins between min and max (max falls in the last bin), all bins listed.

    Also flags a log axis when ``max / (min + 1e-5) > 1000``.
    """
    lf = long_form(df, features).filter(F.col("value").isNotNull())
    rng = lf.groupBy("feature_name").agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    width = (F.col("vmax") - F.col("vmin")) / F.lit(bins)
    idx = F.when(F.col("vmax") == F.col("vmin"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("vmin")) * F.lit(bins) / (F.col("vmax") - F.col("vmin"))), F.lit(bins - 1))
    )
    counts = lf.join(rng, "feature_name").groupBy("feature_name", idx.cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).cast("bigint").alias("count")
    )
    grid = rng.select("feature_name", "vmin", "vmax", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).withColumn(
        "bin", F.col("bin").cast("bigint")
    )
    return grid.join(counts, ["feature_name", "bin"], "left").select(
        "feature_name",
        "bin",
        (F.col("vmin") + width * F.col("bin")).alias("bin_start"),
        (F.col("vmin") + width * (F.col("bin") + 1)).alias("bin_end"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        (F.col("vmax") / (F.col("vmin") + F.lit(1e-5)) > LOG_SCALE_RATIO).alias("log_scale"),
    )


def boxplot_stats(df: DataFrame, features: list[str], factor: float = IQR_FACTOR) -> DataFrame:
    """Median, quartiles, whisker ends (furthest points inside the fences), flier count."""
    lf = long_form(df, features).filter(F.col("value").isNotNull())
    qs = exact_quantiles(lf, ["feature_name"], "value", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    qs = _written(qs.withColumn("lo_fence", F.col("q1") - F.lit(factor) * iqr).withColumn("hi_fence", F.col("q3") + F.lit(factor) * iqr), "box-fences")
    v = F.col("value")
    inside = (v >= F.col("lo_fence")) & (v <= F.col("hi_fence"))
    agg = lf.join(F.broadcast(qs.select("feature_name", "lo_fence", "hi_fence")), "feature_name").groupBy("feature_name").agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).cast("bigint").alias("flier_count"),
    )
    return qs.join(agg, "feature_name").select("feature_name", "q1", "median", "q3", "whisker_low", "whisker_high", "flier_count")


def ranked(df: DataFrame, partition: list[str], order: list, name: str = "rank") -> DataFrame:
    """Contiguous 1-based rank column (row_number) over a bounded table."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("bigint"))
