"""Relational model evaluation over ``(y, pred, probability array)``.

Confusion, per-class and overall metrics are aggregates of the K x K confusion
table.  AUC and curves are exact: distinct (class, score) rows with positive and
negative counts, then bucketed prefix sums (``ordered.ordered_prefix``), so no
window ever holds a whole class.  Every ratio is formed from integer counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.exprs import argmax_index, safe_ratio
from flowlens.operators.ordered import ordered_prefix

Y = "label_idx"
PRED = "pred_idx"
PROBA = "probability"


def add_prediction(scored: DataFrame, proba_col: str = PROBA, pred_col: str = PRED, conf_col: str = "confidence") -> DataFrame:
    """Predicted index = first argmax (numpy tie rule), confidence = max probability."""
    return scored.withColumn(pred_col, argmax_index(F.col(proba_col))).withColumn(conf_col, F.array_max(F.col(proba_col)))


def class_grid(classes: DataFrame, idx_col: str = "idx") -> DataFrame:
    """All (true, predicted) pairs of the K classes (K x K rows, no join)."""
    with_k = classes.select(F.col(idx_col).alias("true_idx"), F.max(idx_col).over(Window.partitionBy()).alias("_k"))
    return with_k.select("true_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k"))).alias("pred_idx"))


def confusion(scored: DataFrame, classes: DataFrame, y_col: str = Y, pred_col: str = PRED) -> DataFrame:
    """Counts for every (true, predicted) cell, zeros included."""
    counts = scored.groupBy(F.col(y_col).alias("true_idx"), F.col(pred_col).alias("pred_idx")).agg(
        F.count(F.lit(1)).cast("bigint").alias("count")
    )
    grid = class_grid(classes)
    return grid.join(counts, ["true_idx", "pred_idx"], "left").select(
        "true_idx", "pred_idx", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")
    )


def class_counts(conf: DataFrame) -> DataFrame:
    """Per class: tp, support (true count), predicted count.  K rows."""
    by_true = conf.groupBy(F.col("true_idx").alias("class_idx")).agg(
        F.sum("count").cast("bigint").alias("support"),
        F.sum(F.when(F.col("true_idx") == F.col("pred_idx"), F.col("count")).otherwise(0)).cast("bigint").alias("tp"),
    )
    by_pred = conf.groupBy(F.col("pred_idx").alias("class_idx")).agg(F.sum("count").cast("bigint").alias("predicted"))
    return by_true.join(by_pred, "class_idx", "full").select(
        "class_idx",
        F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"),
    )


def metrics_per_class(conf: DataFrame) -> DataFrame:
    """precision, recall, F1 (zero division -> 0) and support for classes seen in truth or prediction."""
    cc = class_counts(conf).filter((F.col("support") > 0) | (F.col("predicted") > 0))
    return cc.select(
        "class_idx",
        safe_ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        safe_ratio(F.col("tp"), F.col("support")).alias("recall"),
        safe_ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1_score"),
        "support",
    )


def metrics_overall(per_class: DataFrame) -> DataFrame:
    """accuracy, macro and support-weighted precision / recall / F1 (one row)."""
    n = F.sum("support")
    wavg = lambda m: F.sum(F.col(m) * F.col("support")) / n
    tp = F.sum(F.col("recall") * F.col("support"))
    return per_class.agg(
        (tp / n).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        wavg("precision").alias("precision_weighted"),
        F.avg("recall").alias("recall_macro"),
        wavg("recall").alias("recall_weighted"),
        F.avg("f1_score").alias("f1_macro"),
        wavg("f1_score").alias("f1_weighted"),
    )


def accuracy_exact(conf: DataFrame) -> DataFrame:
    return conf.agg((F.sum(F.when(F.col("true_idx") == F.col("pred_idx"), F.col("count")).otherwise(0)) / F.sum("count")).alias("accuracy"))


def score_points(scored: DataFrame, classes: DataFrame, y_col: str = Y, proba_col: str = PROBA) -> DataFrame:
    """Distinct (class, score) rows with positive / negative counts for one-vs-rest curves."""
    exploded = scored.select(F.col(y_col).alias("_y"), F.posexplode(F.col(proba_col)).alias("class_idx", "score"))
    return exploded.groupBy("class_idx", "score").agg(
        F.count_if(F.col("_y") == F.col("class_idx")).cast("bigint").alias("pos"),
        F.count_if(F.col("_y") != F.col("class_idx")).cast("bigint").alias("neg"),
    ).withColumn("class_idx", F.col("class_idx").cast("bigint"))


def curve_cumulative(points: DataFrame) -> DataFrame:
    """Per (class, score): TP and FP at threshold ``score`` (score >= threshold) and just above it."""
    pre = ordered_prefix(points, ["class_idx"], "score", ["pos", "neg"])
    totals = points.groupBy("class_idx").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))  # K rows
    return (
        pre.join(totals, "class_idx")
        .select(
            "class_idx",
            "score",
            "pos",
            "neg",
            "P",
            "N",
            (F.col("P") - F.col("pos_before")).alias("tp"),
            (F.col("N") - F.col("neg_before")).alias("fp"),
            (F.col("P") - F.col("pos_upto")).alias("tp_above"),
            (F.col("N") - F.col("neg_upto")).alias("fp_above"),
        )
    )


def auc_per_class(points: DataFrame) -> DataFrame:
    """Exact one-vs-rest ROC-AUC per class by rank sum with ties counted half; 0.0 if undefined."""
    pre = ordered_prefix(points, ["class_idx"], "score", ["neg"])
    agg = pre.groupBy("class_idx").agg(
        F.sum("pos").cast("bigint").alias("P"),
        F.sum("neg").cast("bigint").alias("N"),
        # doubles: products of counts pass 2**63 on large tables
        F.sum(F.col("pos").cast("double") * (2.0 * F.col("neg_before") + F.col("neg"))).alias("_num"),
    )
    return agg.select(
        "class_idx",
        "P",
        "N",
        F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_num") / (2.0 * F.col("P").cast("double") * F.col("N").cast("double"))).otherwise(F.lit(0.0)).alias("roc_auc"),
    )


def auc_ovr(auc: DataFrame) -> DataFrame:
    """Macro and prevalence-weighted OVR AUC; 0.0 for both if any class is undefined."""
    defined = F.min(F.when((F.col("P") > 0) & (F.col("N") > 0), 1).otherwise(0)) == 1
    return auc.agg(
        F.when(defined, F.avg("roc_auc")).otherwise(F.lit(0.0)).alias("roc_auc_macro"),
        F.when(defined, F.sum(F.col("roc_auc") * F.col("P")) / F.sum("P")).otherwise(F.lit(0.0)).alias("roc_auc_weighted"),
    )


def roc_curve(cum: DataFrame) -> DataFrame:
    """ROC points per class (every distinct threshold) plus the segment area to the previous point."""
    fpr = F.col("fp") / F.col("N")
    tpr = F.col("tp") / F.col("P")
    fpr0 = F.col("fp_above") / F.col("N")
    tpr0 = F.col("tp_above") / F.col("P")
    return cum.filter((F.col("P") > 0) & (F.col("N") > 0)).select(
        "class_idx",
        F.col("score").alias("threshold"),
        fpr.alias("fpr"),
        tpr.alias("tpr"),
        ((fpr - fpr0) * (tpr + tpr0) / 2.0).alias("segment_area"),
    )


def pr_curve(cum: DataFrame) -> DataFrame:
    """Precision-recall points per class; the curve starts at (recall 0, precision 1)."""
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    rec = F.col("tp") / F.col("P")
    prev_den = F.col("tp_above") + F.col("fp_above")
    prec0 = F.when(prev_den > 0, F.col("tp_above") / prev_den).otherwise(F.lit(1.0))
    rec0 = F.col("tp_above") / F.col("P")
    return cum.filter(F.col("P") > 0).select(
        "class_idx",
        F.col("score").alias("threshold"),
        prec.alias("precision"),
        rec.alias("recall"),
        ((rec - rec0) * (prec + prec0) / 2.0).alias("segment_area"),
    )


def curve_area(curve: DataFrame, name: str) -> DataFrame:
    """Trapezoid area per class from the per-point segments."""
    return curve.groupBy("class_idx").agg(F.sum("segment_area").alias(name))


def classification_report(per_class: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows per class name + accuracy + macro avg + weighted avg (precision, recall, f1-score, support)."""
    names = classes.select(F.col("idx").alias("class_idx"), F.col("label").alias("row_name"))
    rows = per_class.join(names, "class_idx").select(
        "row_name", "precision", "recall", F.col("f1_score").alias("f1-score"), F.col("support").cast("double").alias("support")
    )
    n = F.sum("support").cast("double")
    wavg = lambda m: F.sum(F.col(m) * F.col("support")) / F.sum("support")
    acc = F.sum(F.col("recall") * F.col("support")) / F.sum("support")
    summary = per_class.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("row_name"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1-score"), n.alias("support")),
            F.struct(F.lit("macro avg").alias("row_name"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1-score"), n.alias("support")),
            F.struct(F.lit("weighted avg").alias("row_name"), wavg("precision").alias("precision"), wavg("recall").alias("recall"), wavg("f1_score").alias("f1-score"), n.alias("support")),
        ).alias("r")
    )
    tail = summary.select(F.explode("r").alias("r")).select("r.*")
    return rows.unionByName(tail)


def transpose_report(report: DataFrame) -> DataFrame:
    """The report as long rows ``(row_name, metric, value)``."""
    return report.unpivot(["row_name"], ["precision", "recall", "`f1-score`", "support"], "metric", "value")


def pivot_confusion(conf: DataFrame, classes: DataFrame, names: list[str]) -> DataFrame:
    """Confusion as a matrix: one row per true class, one column per predicted class name."""
    lab = classes.select(F.col("idx").alias("pred_idx"), F.col("label").alias("pred_label"))
    tl = classes.select(F.col("idx").alias("true_idx"), F.col("label").alias("true_label"))
    named = conf.join(lab, "pred_idx").join(tl, "true_idx")
    return named.groupBy("true_label").pivot("pred_label", names).agg(F.sum("count")).fillna(0, subset=names).select(
        "true_label", *[F.col(f"`{n}`").cast("bigint").alias(n) for n in names]
    )


def metrics_long(overall: DataFrame, auc: DataFrame, model: str, split: str) -> DataFrame:
    """Overall metrics + OVR AUC as ``(model, split, metric, value)`` rows."""
    both = overall.unionByName(auc, allowMissingColumns=True).agg(*[F.max(c_).alias(c_) for c_ in overall.columns + auc.columns])
    cols = overall.columns + auc.columns
    return both.unpivot([], cols, "metric", "value").select(F.lit(model).alias("model"), F.lit(split).alias("split"), "metric", "value")


def per_class_long(per_class: DataFrame, auc: DataFrame, classes: DataFrame, model: str) -> DataFrame:
    """Per-class precision / recall / F1 / AUC keyed by class label."""
    names = classes.select(F.col("idx").alias("class_idx"), F.col("label").alias("class_label"))
    return (
        per_class.join(auc.select("class_idx", "roc_auc"), "class_idx", "left")
        .join(names, "class_idx")
        .select(F.lit(model).alias("model"), "class_label", "precision", "recall", "f1_score", F.coalesce("roc_auc", F.lit(0.0)).alias("roc_auc"))
    )
