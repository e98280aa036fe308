"""Batch scoring and the queries a user runs on a prediction table.

``score_batch`` validates and orders the model's features, imputes, scores,
names the class and rounds the confidence (half-even, like numpy).  The result
queries (filter, search, sort, page, summary) are plain DataFrame operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.exprs import argmax_index, c, is_inf, pct_guard
from flowlens.operators.ordered import hash_rank
from flowlens.operators.prepare import with_row_hash

# Fixed values of the reference.
BENIGN = "BENIGN"
UNKNOWN_PREFIX = "Unknown_"
CONFIDENCE_DIGITS = 4
PAGE_SIZES = (10, 25, 50, 100)


class MissingFeaturesError(ValueError):
    def __init__(self, missing: list[str]):
        super().__init__(f"missing required features: {missing}")
        self.missing = missing


def select_features_ordered(df: DataFrame, expected: list[str], keep: list[str] = ()) -> DataFrame:
    """The model's features in model order; error listing every missing one."""
    missing = [f for f in expected if f not in df.columns]
    if missing:
        raise MissingFeaturesError(missing)
    return df.select(*[c(k) for k in keep], *[c(f) for f in expected])


def impute_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """Scoring-time rule: +/-Inf, NaN and NULL become 0.0."""
    out = [
        F.when(c(n).isNull() | F.isnan(c(n)) | is_inf(c(n)), F.lit(0.0)).otherwise(c(n)).cast("double").alias(n) if n in cols else c(n)
        for n in df.columns
    ]
    return df.select(*out)


def pad_missing_features(features: Column, expected: list[str]) -> list[Column]:
    """From a ``map<string,double>`` of given features: one column per expected feature, 0.0 if absent."""
    return [F.coalesce(F.try_element_at(features, F.lit(f)), F.lit(0.0)).alias(f) for f in expected]


def row_numbers(df: DataFrame, seed: int = 42, name: str = "row") -> DataFrame:
    """Stable 0-based row number when the input has no key: rank in salted content-hash order.

    Uses hash-prefix buckets, so no single task sees the whole table.
    """
    hashed = with_row_hash(df, seed, "_h")
    return hash_rank(hashed, [], "_h").withColumnRenamed("_rank", name).drop("_h", "_n")


def join_label_map(preds: DataFrame, mapping: DataFrame, idx_col: str = "pred_idx") -> DataFrame:
    """Index -> class name; unknown indexes become ``Unknown_<idx>`` (K-row map, AQE broadcast)."""
    m = mapping.select(F.col("idx").alias("_pidx"), F.col("label").alias("_plabel"))
    out = preds.join(m, F.col(idx_col) == F.col("_pidx"), "left")
    return out.withColumn("prediction", F.coalesce(F.col("_plabel"), F.concat(F.lit(UNKNOWN_PREFIX), F.col(idx_col).cast("string")))).drop(
        "_pidx", "_plabel"
    )


def score_batch(
    df: DataFrame,
    expected: list[str],
    probability: Callable[[DataFrame], Column],
    mapping: DataFrame,
    row_col: str | None = None,
) -> DataFrame:
    """``(row, prediction, confidence)`` for every input row.

    ``probability`` maps the ordered, imputed feature frame to an array column of
    class probabilities (a rule, or a fitted model's ``vector_to_array``).
    """
    if row_col is None:
        df = row_numbers(df)
        row_col = "row"
    x = impute_zero(select_features_ordered(df, expected, keep=[row_col]), expected)
    scored = x.withColumn("_p", probability(x))
    scored = scored.withColumn("pred_idx", argmax_index(F.col("_p"))).withColumn(
        "confidence", F.bround(F.array_max(F.col("_p")), CONFIDENCE_DIGITS)
    )
    named = join_label_map(scored, mapping)
    return named.select(F.col(row_col).cast("bigint").alias("row"), "prediction", "confidence")


def is_benign(pred: Column) -> Column:
    return F.upper(pred) == F.lit(BENIGN)


def prediction_summary(preds: DataFrame) -> DataFrame:
    """total, predicted attacks, predicted benign (one row)."""
    return preds.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_samples"),
        F.count_if(~is_benign(F.col("prediction"))).cast("bigint").alias("predicted_attacks"),
        F.count_if(is_benign(F.col("prediction"))).cast("bigint").alias("predicted_benign"),
    )


def attack_vector_count(preds: DataFrame) -> DataFrame:
    """Distinct attack classes predicted, and benign / attack shares rounded to one decimal."""
    n = F.count(F.lit(1))
    return preds.agg(
        F.count_distinct(F.when(~is_benign(F.col("prediction")), F.col("prediction"))).cast("bigint").alias("attack_vectors"),
        F.round(pct_guard(F.count_if(is_benign(F.col("prediction"))), n), 1).alias("benign_pct"),
        F.round(pct_guard(F.count_if(~is_benign(F.col("prediction"))), n), 1).alias("attack_pct"),
    )


def filter_category(preds: DataFrame, category: str = "all") -> DataFrame:
    """all / attacks / benign (case-insensitive class name)."""
    if category == "attacks":
        return preds.filter(~is_benign(F.col("prediction")))
    if category == "benign":
        return preds.filter(is_benign(F.col("prediction")))
    return preds


def search_predictions(preds: DataFrame, term: str) -> DataFrame:
    """Substring match on the row number or the lower-cased class name; a blank term matches every row."""
    t = term.strip().lower()
    if not t:
        return preds
    return preds.filter(F.col("row").cast("string").contains(t) | F.lower(F.col("prediction")).contains(t))


def sort_predictions(preds: DataFrame, field: str = "row", descending: bool = False) -> DataFrame:
    """Sort by row, lower-cased class or confidence; the row number breaks ties."""
    key = F.lower(F.col("prediction")) if field == "prediction" else F.col(field)
    key = key.desc() if descending else key.asc()
    return preds.orderBy(key, F.col("row").asc())


def page_predictions(preds: DataFrame, page: int, size: int, field: str = "row", descending: bool = False) -> DataFrame:
    """One page (1-based) of the sorted table; the page number is clamped to the valid range."""
    if size not in PAGE_SIZES:
        raise ValueError(f"page size must be one of {PAGE_SIZES}")
    total = preds.count()
    pages = max(1, -(-total // size))
    page = min(max(1, page), pages)
    return sort_predictions(preds, field, descending).offset((page - 1) * size).limit(size)


def lookup_row(preds: DataFrame, features: DataFrame, row_col: str = "row") -> DataFrame:
    """Prediction rows with their feature values (left join on the row key; none -> NULLs)."""
    return preds.join(features, row_col, "left")
