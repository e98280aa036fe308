"""Aggregations over a long attribution table.

Layout: ``(row_id, class_idx, feature_name, feature_idx, value, phi)`` -- one row
per explained row, class and feature; never a dense tensor on the driver.
Rankings are over P-feature tables (bounded by the feature count); per-row
orderings are windows over one row's P attributions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reference's reports.
TOP_GLOBAL = 20
TOP_CLASS = 10
TOP_COMPARE = 15
TOP_SIGNED = 5
BAR_TOP = 10
BAR_FLOOR = 0.001
BAR_MIN, BAR_MAX = 4.0, 100.0


def _rank(df: DataFrame, partition: list[str], value: str, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(F.col(value).desc(), F.col("feature_name"))
    return df.withColumn(name, F.row_number().over(w).cast("bigint"))


def class_importance(attr: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Mean |phi| per (class, feature) and the rank inside the class."""
    per = attr.groupBy("class_idx", "feature_name").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))
    per = _rank(per, ["class_idx"], "mean_abs_shap")
    if classes is not None:
        per = per.join(classes.select(F.col("idx").alias("class_idx"), F.col("label").alias("class_label")), "class_idx")
        return per.select("class_label", "rank", "feature_name", "mean_abs_shap")
    return per.select("class_idx", "rank", "feature_name", "mean_abs_shap")


def global_importance(attr: DataFrame) -> DataFrame:
    """Mean over classes of the per-class mean |phi|, ranked (1 = largest)."""
    per = attr.groupBy("class_idx", "feature_name").agg(F.avg(F.abs("phi")).alias("m"))
    glob = per.groupBy("feature_name").agg(F.avg("m").alias("mean_abs_shap"))
    return _rank(glob, [], "mean_abs_shap").select("rank", "feature_name", "mean_abs_shap")


def row_mean_abs(attr: DataFrame) -> DataFrame:
    """Per explained row and feature: mean over classes of |phi| (beeswarm data)."""
    return attr.groupBy("row_id", "feature_name").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))


def builtin_ranking(importance: DataFrame) -> DataFrame:
    """``(feature_name, importance)`` -> adds ``builtin_rank``."""
    return _rank(importance, [], "importance", "builtin_rank")


def join_importance(glob: DataFrame, builtin: DataFrame) -> DataFrame:
    """Inner join of the attribution ranking and the built-in ranking, in attribution-rank order."""
    return glob.join(builtin, "feature_name", "inner").select(
        "rank", "feature_name", "mean_abs_shap", "importance", "builtin_rank"
    ).orderBy("rank")


def top_global(glob: DataFrame, k: int = TOP_GLOBAL) -> DataFrame:
    return glob.filter(F.col("rank") <= k)


def top_class(cls_imp: DataFrame, k: int = TOP_CLASS) -> DataFrame:
    return cls_imp.filter(F.col("rank") <= k)


def top_compare(joined: DataFrame, k: int = TOP_COMPARE) -> DataFrame:
    return joined.filter(F.col("rank") <= k)


def top_builtin(builtin: DataFrame, k: int = TOP_GLOBAL) -> DataFrame:
    return builtin.filter(F.col("builtin_rank") <= k)


def representative_rows(labels: DataFrame, row_col: str = "row_id", class_col: str = "class_idx") -> DataFrame:
    """First explained row of each class (classes without rows are absent).  Partial aggregate."""
    return labels.groupBy(F.col(class_col).alias("class_idx")).agg(F.min(row_col).alias("row_id"))


def representative(attr: DataFrame, labels: DataFrame) -> DataFrame:
    """phi of each class's first row, for that class."""
    reps = representative_rows(labels)
    return attr.join(reps, ["class_idx", "row_id"]).select("class_idx", "row_id", "feature_name", "feature_idx", "value", "phi")


def waterfall(attr_rows: DataFrame, base: DataFrame) -> DataFrame:
    """Running sum from the base value to the output, features by |phi| descending.

    ``base`` is ``(class_idx, base_value)``.  The window spans one row's P
    attributions for one class.
    """
    w = Window.partitionBy("row_id", "class_idx").orderBy(F.abs("phi").desc(), F.col("feature_idx"))
    run = Window.partitionBy("row_id", "class_idx").orderBy(F.abs("phi").desc(), F.col("feature_idx")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        attr_rows.join(base, "class_idx")
        .withColumn("step", F.row_number().over(w).cast("bigint"))
        .withColumn("cumulative", F.col("base_value") + F.sum("phi").over(run))
        .select("row_id", "class_idx", "step", "feature_name", "phi", "base_value", "cumulative")
    )


def topk_attr_row(attr_rows: DataFrame) -> DataFrame:
    """Every feature of every row ranked by |phi| descending; ties keep feature order."""
    w = Window.partitionBy("row_id").orderBy(F.abs("phi").desc(), F.col("feature_idx"))
    return attr_rows.withColumn("position", F.row_number().over(w).cast("bigint")).select(
        "row_id", "position", "feature_name", "value", "phi"
    )


def filter_sign(attr_rows: DataFrame, positive: bool = True) -> DataFrame:
    """Positive (phi >= 0) or negative (phi < 0) contributions."""
    return attr_rows.filter(F.col("phi") >= 0 if positive else F.col("phi") < 0)


def topk_signed(attr_rows: DataFrame, k: int = TOP_SIGNED, bar_top: int = BAR_TOP) -> DataFrame:
    """Per row: top-k positive and top-k negative by |phi|, and bar widths of the top ten.

    Bar width = clamp(100 * |phi| / max(0.001, max |phi| among the top ten), 4, 100).
    """
    order_abs = [F.abs("phi").desc(), F.col("feature_idx")]
    w_all = Window.partitionBy("row_id").orderBy(*order_abs)
    w_sign = Window.partitionBy("row_id", F.col("phi") >= 0).orderBy(*order_abs)
    ranked = attr_rows.withColumn("position", F.row_number().over(w_all)).withColumn("sign_rank", F.row_number().over(w_sign))
    top_max = F.max(F.when(F.col("position") <= bar_top, F.abs("phi"))).over(Window.partitionBy("row_id"))
    width = F.least(F.greatest(F.lit(100.0) * F.abs("phi") / F.greatest(F.lit(BAR_FLOOR), top_max), F.lit(BAR_MIN)), F.lit(BAR_MAX))
    return (
        ranked.withColumn("bar_width", F.when(F.col("position") <= bar_top, width))
        .filter((F.col("sign_rank") <= k) | (F.col("position") <= bar_top))
        .select(
            "row_id",
            F.col("position").cast("bigint").alias("position"),
            F.when(F.col("phi") >= 0, F.lit("positive")).otherwise(F.lit("negative")).alias("sign"),
            F.when(F.col("sign_rank") <= k, F.col("sign_rank")).cast("bigint").alias("sign_rank"),
            "feature_name",
            "phi",
            "bar_width",
        )
    )
