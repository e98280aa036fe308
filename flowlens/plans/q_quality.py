"""Registered queries: labels, cleaning steps, audit, profiles, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import quality as Q
from flowlens.plans.fixtures import CLEAN_FEATURES, FEATURES, FLOWS_CONSTANT, FLOWS_SQL, LABEL, flows
from flowlens.plans.registry import register
from flowlens.plans.stages import stage
from flowlens.plans.sqltext import _rare_list, label_norm_sql, with_clean

ALL = [LABEL] + FEATURES


def flows_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingested (merged) flows: labels normalised, NaN as NULL (rule S1), a written stage.

    Writing the merged table before cleaning is the reference's own hand-off; it
    also keeps Catalyst from pushing the cleaning filters below the label and
    NaN/Inf projections, which would repeat those expressions per row.
    """
    return stage(spark, "flows_in", sf_dir, lambda: Q.nan_to_null(Q.std_labels(flows(spark, sf_dir), LABEL)))


def flows_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned flows in the reference order of steps (a written stage)."""
    return stage(spark, "flows_clean", sf_dir, lambda: Q.clean(flows_in(spark, sf_dir), LABEL, Q.RARE_CLASSES, FLOWS_CONSTANT))


def _cols(names: list[str]) -> str:
    return ", ".join(names)


@register("std_labels", with_clean(f"SELECT {_cols(ALL)} FROM flows_in"))
def q_std_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_in(spark, sf_dir)


@register(
    "std_columns",
    f"SELECT {label_norm_sql('label')} AS \"Label\", destination_port AS \"Destination Port\", "
    "flow_bytes_s AS \"Flow Bytes/s\" FROM (" + FLOWS_SQL + ")",
)
def q_std_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = flows(spark, sf_dir).select(
        F.col(LABEL).alias(" Label"), F.col("destination_port").alias(" Destination  Port "), F.col("flow_bytes_s").alias("Flow   Bytes/s")
    )
    out = Q.std_columns(raw)
    return Q.std_labels(out, "Label").select("Label", "Destination Port", "Flow Bytes/s")


@register(
    "drop_rare_classes",
    with_clean(
        "SELECT k.class_label, CAST(count(f.label) AS BIGINT) AS removed_count "
        f"FROM (SELECT unnest([{_rare_list()}]) AS class_label) k LEFT JOIN flows_in f ON f.label = k.class_label "
        "GROUP BY k.class_label"
    ),
)
def q_drop_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, removed = Q.drop_rare_classes(flows_in(spark, sf_dir), Q.RARE_CLASSES, LABEL)
    return removed.withColumn("removed_count", F.col("removed_count").cast("bigint"))


@register("replace_inf", with_clean(f"SELECT {_cols(ALL)} FROM flows_noinf"))
def q_replace_inf(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = Q.drop_rare_classes(flows_in(spark, sf_dir), Q.RARE_CLASSES, LABEL)
    out, _ = Q.replace_inf(kept)
    return out


@register("dedup_rows", with_clean(f"SELECT {_cols(ALL)} FROM flows_dedup"))
def q_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = Q.drop_rare_classes(flows_in(spark, sf_dir), Q.RARE_CLASSES, LABEL)
    out, _ = Q.replace_inf(kept)
    deduped, _ = Q.dedup_rows(out)
    return deduped


@register("drop_missing", with_clean(f"SELECT {_cols(ALL)} FROM flows_nomissing"))
def q_drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = Q.drop_rare_classes(flows_in(spark, sf_dir), Q.RARE_CLASSES, LABEL)
    out, _ = Q.replace_inf(kept)
    out = out.dropDuplicates()
    res, _ = Q.drop_missing(out)
    return res


@register("drop_columns", with_clean(f"SELECT {_cols([LABEL] + CLEAN_FEATURES)} FROM flows_clean"))
def q_drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_clean(spark, sf_dir)


_AUDIT_SQL = with_clean(
    """
SELECT CAST(step_order AS BIGINT) AS step_order, step, CAST(value AS BIGINT) AS value FROM (
  SELECT 0 AS step_order, 'original_samples' AS step, (SELECT count(*) FROM flows_in) AS value
  UNION ALL SELECT 1, 'removed_heartbleed', (SELECT count(*) FROM flows_in WHERE label = 'Heartbleed')
  UNION ALL SELECT 2, 'removed_infiltration', (SELECT count(*) FROM flows_in WHERE label = 'Infiltration')
  UNION ALL SELECT 3, 'replaced_infinities', (SELECT """
    + " + ".join(f"count(*) FILTER (WHERE isinf({f}))" for f in FEATURES)
    + """ FROM flows_norare)
  UNION ALL SELECT 4, 'removed_duplicates', (SELECT count(*) FROM flows_noinf) - (SELECT count(*) FROM flows_dedup)
  UNION ALL SELECT 5, 'removed_missing', (SELECT count(*) FROM flows_dedup) - (SELECT count(*) FROM flows_nomissing)
  UNION ALL SELECT 6, 'dropped_features', 1
  UNION ALL SELECT 7, 'final_samples', (SELECT count(*) FROM flows_clean)
)"""
)


@register("clean_audit", _AUDIT_SQL)
def q_clean_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.clean_audit(flows_in(spark, sf_dir), LABEL, Q.RARE_CLASSES, FLOWS_CONSTANT)


_VALIDATE_SQL = with_clean(
    f"""
SELECT CAST(count(*) AS BIGINT) AS num_samples, CAST({len(CLEAN_FEATURES) + 1} AS BIGINT) AS num_features,
       CAST(count(DISTINCT label) AS BIGINT) AS num_classes,
       string_agg(DISTINCT label, ',' ORDER BY label) AS classes,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM flows_clean)) AS BIGINT) AS remaining_duplicates,
       CAST(sum({" + ".join(f"(CASE WHEN {n} IS NULL OR isnan({n}) THEN 1 ELSE 0 END)" for n in CLEAN_FEATURES)} + (CASE WHEN label IS NULL THEN 1 ELSE 0 END)) AS BIGINT) AS remaining_missing,
       CAST(sum({" + ".join(f"(CASE WHEN isinf({n}) THEN 1 ELSE 0 END)" for n in CLEAN_FEATURES)}) AS BIGINT) AS remaining_infinite
FROM flows_clean"""
)


@register("validate_clean", _VALIDATE_SQL)
def q_validate_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.validate_clean(flows_clean(spark, sf_dir), LABEL)


@register(
    "count_duplicates",
    with_clean("SELECT CAST((SELECT count(*) FROM flows_in) - (SELECT count(*) FROM (SELECT DISTINCT * FROM flows_in)) AS BIGINT) AS duplicate_count"),
)
def q_count_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.count_duplicates(flows_in(spark, sf_dir))


_SUMMARY_SQL = with_clean(
    f"""
SELECT CAST(1 AS BIGINT) AS num_files, CAST(count(*) AS BIGINT) AS total_samples, CAST({len(ALL)} AS BIGINT) AS num_features,
       '{",".join(sorted(ALL))}' AS feature_names,
       string_agg(DISTINCT label, ',' ORDER BY label) AS unique_labels,
       CAST(count(DISTINCT label) AS BIGINT) AS num_labels,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM flows_in)) AS BIGINT) AS duplicate_count,
       CAST(sum({" + ".join(f"(CASE WHEN {n} IS NULL THEN 1 ELSE 0 END)" for n in ALL)}) AS BIGINT) AS missing_count,
       CAST(sum({" + ".join(f"(CASE WHEN isinf({n}) THEN 1 ELSE 0 END)" for n in FEATURES)}) AS BIGINT) AS inf_count
FROM flows_in"""
)


@register("agg_dataset_summary", _SUMMARY_SQL)
def q_dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.dataset_summary(flows_in(spark, sf_dir), LABEL)


def _profile_sql() -> str:
    parts = []
    for f in FEATURES:
        parts.append(
            f"""SELECT '{f}' AS feature_name, 'float64' AS dtype,
  CAST(count(*) FILTER (WHERE {f} IS NULL) AS BIGINT) AS missing_count,
  CAST(count(*) FILTER (WHERE isinf({f})) AS BIGINT) AS infinite_count,
  CAST(count(DISTINCT {f}) + max(CASE WHEN {f} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unique_count,
  CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM flows_in GROUP BY {f})) AS BIGINT) AS mode_count,
  CAST(count(*) AS BIGINT) AS num_samples FROM flows_in"""
        )
    parts.append(
        """SELECT 'label', 'object',
  CAST(count(*) FILTER (WHERE label IS NULL) AS BIGINT), CAST(0 AS BIGINT),
  CAST(count(DISTINCT label) + max(CASE WHEN label IS NULL THEN 1 ELSE 0 END) AS BIGINT),
  CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM flows_in GROUP BY label)) AS BIGINT),
  CAST(count(*) AS BIGINT) FROM flows_in"""
    )
    body = " UNION ALL ".join(f"({p})" for p in parts)
    return with_clean(
        f"""
SELECT feature_name, dtype, missing_count,
  CASE WHEN num_samples > 0 THEN missing_count / num_samples * 100.0 ELSE 0.0 END AS missing_pct,
  infinite_count,
  CASE WHEN num_samples > 0 THEN infinite_count / num_samples * 100.0 ELSE 0.0 END AS infinite_pct,
  unique_count,
  unique_count = 1 AS is_constant,
  (unique_count <> 1 AND num_samples > 0 AND mode_count / num_samples >= 0.99) AS is_near_constant,
  missing_count = num_samples AS is_empty,
  (dtype = 'object' AND feature_name <> 'label') AS is_object_type,
  (dtype = 'object' AND feature_name <> 'label' AND unique_count > 10) AS is_high_cardinality
FROM ({body})"""
    )


@register("profile_features", _profile_sql())
def q_profile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.profile_features(flows_in(spark, sf_dir), LABEL)


_DIST_CTE = "dist AS (SELECT coalesce(label, 'nan') AS class_label, CAST(count(*) AS BIGINT) AS sample_count FROM {src} GROUP BY 1)"


@register(
    "profile_labels",
    with_clean(
        "SELECT class_label, sample_count, sample_count / sum(sample_count) OVER () * 100.0 AS percentage, "
        "sample_count / sum(sample_count) OVER () * 100.0 < 0.5 AS is_severely_imbalanced FROM dist",
        _DIST_CTE.format(src="flows_in"),
    ),
)
def q_profile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.profile_labels(flows_in(spark, sf_dir), LABEL)


@register(
    "class_distribution_clean",
    with_clean(
        "SELECT class_label, sample_count, sample_count / sum(sample_count) OVER () * 100.0 AS percentage FROM dist",
        _DIST_CTE.format(src="flows_clean"),
    ),
)
def q_class_distribution_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.class_distribution_clean(flows_clean(spark, sf_dir), LABEL)


@register(
    "class_distribution",
    with_clean(
        "SELECT class_label, sample_count, sample_count / sum(sample_count) OVER () * 100.0 AS percentage, "
        "CASE WHEN row_number() OVER (ORDER BY sample_count DESC, class_label) = 1 THEN 'Majority' ELSE 'Minority' END AS role FROM dist",
        _DIST_CTE.format(src="flows_clean"),
    ),
)
def q_class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.class_distribution(flows_clean(spark, sf_dir), LABEL)


@register(
    "eda_overview",
    with_clean(
        f"SELECT CAST(count(*) AS BIGINT) AS num_samples, CAST({len(CLEAN_FEATURES)} AS BIGINT) AS num_predictors, "
        f"CAST(count(DISTINCT label) AS BIGINT) AS num_classes, 'float64:{len(CLEAN_FEATURES)}' AS dtype_counts FROM flows_clean"
    ),
)
def q_eda_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.eda_overview(flows_clean(spark, sf_dir), LABEL)


@register("agg_basic_metrics")
def q_basic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.basic_metrics(flows_in(spark, sf_dir))


@register(
    "report_lines",
    _AUDIT_SQL.replace(
        "SELECT CAST(step_order AS BIGINT) AS step_order, step, CAST(value AS BIGINT) AS value FROM (",
        "SELECT 'cleaning' AS section, CAST(step_order AS BIGINT) AS ord, printf('%s: %d', step, CAST(value AS BIGINT)) AS line FROM (",
    ),
)
def q_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.operators.reshape import report_lines

    audit = Q.clean_audit(flows_in(spark, sf_dir), LABEL, Q.RARE_CLASSES, FLOWS_CONSTANT)
    return report_lines(audit, "cleaning", "step_order", "%s: %d", ["step", "value"])
