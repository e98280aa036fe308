"""Registered queries: encoding, exact split, sample, folds, weights, split checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import prepare as P
from flowlens.plans.fixtures import CLEAN_FEATURES, LABEL
from flowlens.plans.q_quality import flows_clean
from flowlens.plans.registry import register
from flowlens.plans.stages import stage
from flowlens.plans.sqltext import hash_sql, with_prepared

COLS = [LABEL] + CLEAN_FEATURES
SAMPLE_SIZE = 1000


def flows_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_enc(spark, sf_dir).drop("label_idx")


def flows_enc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, split and encoded flows (``label_idx``), a written stage."""

    def build() -> DataFrame:
        clean = flows_clean(spark, sf_dir)
        return P.label_encode(P.stratified_split(clean, LABEL), LABEL, P.label_mapping(clean, LABEL))

    return stage(spark, "flows_enc", sf_dir, build)


def split_part(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return flows_split(spark, sf_dir).filter(F.col("split") == name).drop("split")


@register("label_encode", with_prepared("SELECT label, idx FROM lmap"))
def q_label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.label_mapping(flows_clean(spark, sf_dir), LABEL)


@register("split_xy", with_prepared(f"SELECT {', '.join(CLEAN_FEATURES)}, label_idx FROM flows_enc"))
def q_split_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = flows_enc(spark, sf_dir)
    x, y = P.split_xy(enc.drop(LABEL, "split"), "label_idx")
    return enc.select(*x.columns, *y.columns)


@register("stratified_split", with_prepared(f"SELECT {', '.join(COLS)}, split FROM flows_split"))
def q_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computes the split itself (not the written stage)."""
    return P.stratified_split(flows_clean(spark, sf_dir), LABEL)


_SAMPLE_CTES = f"""
t AS (SELECT {", ".join(COLS)} FROM flows_split WHERE split = 'test'),
tr AS (SELECT *, row_number() OVER (PARTITION BY {LABEL} ORDER BY {hash_sql(COLS)}) - 1 AS _rank FROM t),
q0 AS (SELECT {LABEL} AS ql, count(*) AS n_c, sum(count(*)) OVER () AS nn FROM t GROUP BY {LABEL}),
q1 AS (SELECT ql, (n_c * least({SAMPLE_SIZE}, nn)) // nn AS fl, (n_c * least({SAMPLE_SIZE}, nn)) % nn AS rem, least({SAMPLE_SIZE}, nn) AS target FROM q0),
q2 AS (SELECT ql, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, ql) <= target - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM q1)"""


@register(
    "stratified_sample",
    with_prepared(f"SELECT {', '.join(COLS)} FROM tr JOIN q2 ON tr.{LABEL} = q2.ql WHERE _rank < quota", _SAMPLE_CTES),
)
def q_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stratified_sample(split_part(spark, sf_dir, "test"), SAMPLE_SIZE, LABEL)


@register(
    "kfold_stratified",
    with_prepared(
        f"SELECT {', '.join(COLS)}, CAST((row_number() OVER (PARTITION BY {LABEL} ORDER BY {hash_sql(COLS)}) - 1) % 3 AS BIGINT) AS fold "
        "FROM flows_split WHERE split = 'train'"
    ),
)
def q_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.kfold_stratified(split_part(spark, sf_dir, "train"), LABEL)


@register(
    "class_weights",
    with_prepared(
        "SELECT label_idx, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM flows_enc WHERE split = 'train' GROUP BY label_idx"
    ),
)
def q_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.class_weights(flows_enc(spark, sf_dir).filter(F.col("split") == "train"))


_REPORT_CTE = """
dist AS (SELECT split, label_idx, count(*) / sum(count(*)) OVER (PARTITION BY split) AS proportion FROM flows_enc GROUP BY split, label_idx),
rep AS (SELECT label_idx,
  coalesce(max(proportion) FILTER (WHERE split = 'train'), 0.0) AS train_proportion,
  coalesce(max(proportion) FILTER (WHERE split = 'valid'), 0.0) AS valid_proportion,
  coalesce(max(proportion) FILTER (WHERE split = 'test'), 0.0) AS test_proportion FROM dist GROUP BY label_idx)"""


@register("split_report", with_prepared("SELECT * FROM rep", _REPORT_CTE))
def q_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_report(flows_enc(spark, sf_dir))


_MISS = " + ".join(f"(CASE WHEN {f} IS NULL OR isnan({f}) THEN 1 ELSE 0 END)" for f in CLEAN_FEATURES)
_INF = " + ".join(f"(CASE WHEN isinf({f}) THEN 1 ELSE 0 END)" for f in CLEAN_FEATURES)


@register(
    "validate_splits",
    with_prepared(
        f"""SELECT true AS identical_features,
  (SELECT sum({_MISS} + CASE WHEN label_idx IS NULL THEN 1 ELSE 0 END) FROM flows_enc) = 0 AS no_missing,
  (SELECT sum({_INF}) FROM flows_enc) = 0 AS no_infinite,
  (count(*) FILTER (WHERE train_proportion > 0) = count(*) AND count(*) FILTER (WHERE valid_proportion > 0) = count(*)
     AND count(*) FILTER (WHERE test_proportion > 0) = count(*)) AS all_classes_present,
  max(abs(valid_proportion - train_proportion)) AS max_diff_valid,
  max(abs(test_proportion - train_proportion)) AS max_diff_test,
  (max(abs(valid_proportion - train_proportion)) < 0.01 AND max(abs(test_proportion - train_proportion)) < 0.01) AS stratification_preserved
FROM rep""",
        _REPORT_CTE,
    ),
)
def q_validate_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.validate_splits(flows_enc(spark, sf_dir))
