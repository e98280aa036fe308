"""Model comparison from long metric tables ``(model, split, metric, value)``.

Inputs are small (metrics x models x splits); every operator is a pivot,
a full outer join or a one-row aggregate over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metric keys and their display names, in report order.
METRIC_LABELS = [
    ("Accuracy", "accuracy"),
    ("Macro Precision", "precision_macro"),
    ("Weighted Precision", "precision_weighted"),
    ("Macro Recall", "recall_macro"),
    ("Weighted Recall", "recall_weighted"),
    ("Macro F1", "f1_macro"),
    ("Weighted F1", "f1_weighted"),
    ("Macro ROC-AUC", "roc_auc_macro"),
    ("Weighted ROC-AUC", "roc_auc_weighted"),
    ("Training Time (s)", "training_time_seconds"),
    ("Test Inference Time (s)", "inference_time_seconds"),
]
# Fixed value: floor of a time in the speed-up ratio.
TIME_FLOOR = 1e-5


def _labels(spark) -> DataFrame:
    return spark.createDataFrame([(k, v, i) for i, (v, k) in enumerate(METRIC_LABELS)], "metric string, label string, ord int")


def compare_overall(long: DataFrame, times: DataFrame | None = None, a: str = "A", b: str = "B") -> DataFrame:
    """Metric x (A test, B test, B - A, A valid, B valid)."""
    data = long if times is None else long.unionByName(times)
    lab = _labels(long.sparkSession)

    def pick(model: str, split: str):
        return F.max(F.when((F.col("model") == model) & (F.col("split") == split), F.col("value")))

    return (
        data.join(F.broadcast(lab), "metric")  # fixed 11-row table
        .groupBy(F.col("label").alias("metric"))
        .agg(
            pick(a, "test").alias("a_test"),
            pick(b, "test").alias("b_test"),
            (pick(b, "test") - pick(a, "test")).alias("difference_b_minus_a"),
            pick(a, "valid").alias("a_valid"),
            pick(b, "valid").alias("b_valid"),
        )
    )


def join_per_class_full(pa: DataFrame, pb: DataFrame) -> DataFrame:
    """Per-class metrics side by side over the union of both models' classes, 0.0 when absent."""
    cols = ["precision", "recall", "f1_score", "roc_auc"]
    a = pa.select("class_label", *[F.col(c_).alias(f"_a_{c_}") for c_ in cols])
    b = pb.select("class_label", *[F.col(c_).alias(f"_b_{c_}") for c_ in cols])
    j = a.join(b, "class_label", "full")
    z = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    return j.select(
        "class_label",
        z("_a_precision").alias("a_precision"),
        z("_b_precision").alias("b_precision"),
        z("_a_recall").alias("a_recall"),
        z("_b_recall").alias("b_recall"),
        z("_a_f1_score").alias("a_f1"),
        z("_b_f1_score").alias("b_f1"),
        z("_a_roc_auc").alias("a_roc_auc"),
        z("_b_roc_auc").alias("b_roc_auc"),
        (z("_b_f1_score") - z("_a_f1_score")).alias("f1_difference_b_minus_a"),
    )


compare_per_class = join_per_class_full


def set_all_classes(pa: DataFrame, pb: DataFrame) -> DataFrame:
    """Union of both models' class labels."""
    return pa.select("class_label").union(pb.select("class_label")).distinct()


def unpivot_metrics(overall: DataFrame, a_name: str = "Model A", b_name: str = "Model B") -> DataFrame:
    """Wide test metrics -> (metric, model, score) with display names for the models."""
    return overall.select("metric", F.col("a_test").alias(a_name), F.col("b_test").alias(b_name)).unpivot(
        ["metric"], [a_name, b_name], "model", "score"
    )


def pick_winners(overall: DataFrame, a_name: str = "Model A", b_name: str = "Model B") -> DataFrame:
    """Highest macro F1 (or Tie), best overall (F1 then accuracy), fastest + speed-up, most balanced."""

    def get(metric: str, col: str):
        return F.max(F.when(F.col("metric") == metric, F.col(col)))

    one = overall.agg(
        get("Macro F1", "a_test").alias("fa"),
        get("Macro F1", "b_test").alias("fb"),
        get("Accuracy", "a_test").alias("aa"),
        get("Accuracy", "b_test").alias("ab"),
        F.coalesce(get("Test Inference Time (s)", "a_test"), F.lit(0.0)).alias("ta"),
        F.coalesce(get("Test Inference Time (s)", "b_test"), F.lit(0.0)).alias("tb"),
        F.abs(get("Macro Precision", "a_test") - get("Macro Recall", "a_test")).alias("gap_a"),
        F.abs(get("Macro Precision", "b_test") - get("Macro Recall", "b_test")).alias("gap_b"),
    )
    fa, fb, ta, tb = F.col("fa"), F.col("fb"), F.col("ta"), F.col("tb")
    return one.select(
        F.when(fb > fa, F.lit(b_name)).when(fa > fb, F.lit(a_name)).otherwise(F.lit("Tie")).alias("highest_macro_f1_model"),
        F.when(fb > fa, fb).otherwise(fa).alias("highest_macro_f1_score"),
        F.when((fb > fa) | ((fb == fa) & (F.col("ab") >= F.col("aa"))), F.lit(b_name)).otherwise(F.lit(a_name)).alias("best_overall_model"),
        F.when(ta < tb, F.lit(a_name)).otherwise(F.lit(b_name)).alias("fastest_model"),
        F.when(ta < tb, tb / F.greatest(ta, F.lit(TIME_FLOOR))).otherwise(ta / F.greatest(tb, F.lit(TIME_FLOOR))).alias("inference_speedup_factor"),
        F.when(F.col("gap_b") < F.col("gap_a"), F.lit(b_name)).otherwise(F.lit(a_name)).alias("most_balanced_model"),
        F.col("gap_a").alias("a_precision_recall_gap"),
        F.col("gap_b").alias("b_precision_recall_gap"),
    )
