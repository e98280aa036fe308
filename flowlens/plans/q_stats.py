"""Registered queries: statistics over cleaned flows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession


from flowlens.operators import stats as S
from flowlens.plans.fixtures import CLEAN_FEATURES, FEATURES, LABEL
from flowlens.plans.q_quality import flows_clean, flows_in
from flowlens.plans.registry import register
from flowlens.plans.sqltext import with_clean

REP = CLEAN_FEATURES[:4]


def long_sql(src: str, feats: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature_name, CAST({f} AS DOUBLE) AS value FROM {src}" for f in feats)


def _describe_sql(src: str, feats: list[str]) -> str:
    return with_clean(
        """SELECT feature_name, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
  quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75, max(value) AS max
FROM lf WHERE value IS NOT NULL GROUP BY feature_name""",
        f"lf AS ({long_sql(src, feats)})",
    )


@register("describe_numeric", _describe_sql("flows_clean", CLEAN_FEATURES))
def q_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.describe_numeric(flows_clean(spark, sf_dir), LABEL)


@register("describe_raw", _describe_sql("flows_in", FEATURES))
def q_describe_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.describe_numeric(flows_in(spark, sf_dir), LABEL)


@register("describe_approx")
def q_describe_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.describe_numeric(flows_clean(spark, sf_dir), LABEL, approx=True)


def _corr_sql(src: str, feats: list[str]) -> str:
    parts = []
    for a, b in combinations(feats, 2):
        r = (
            f"(SELECT CASE WHEN stddev_samp({a}) * stddev_samp({b}) <> 0 THEN covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) END "
            f"FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        )
        parts.append(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {r} AS correlation")
        parts.append(f"SELECT '{b}', '{a}', {r}")
    for a in feats:
        parts.append(f"SELECT '{a}', '{a}', (SELECT CASE WHEN stddev_samp({a}) <> 0 THEN 1.0::DOUBLE END FROM {src})")
    return " UNION ALL ".join(parts)


@register("corr_matrix", with_clean(_corr_sql("flows_clean", CLEAN_FEATURES)))
def q_corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.corr_matrix(flows_clean(spark, sf_dir), LABEL)


@register("corr_matrix_constant", with_clean(_corr_sql("flows_nomissing", FEATURES)))
def q_corr_matrix_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before the constant column is dropped: its correlations are NULL, not an error."""
    from flowlens.plans.q_quality import q_drop_missing

    return S.corr_matrix(q_drop_missing(spark, sf_dir), LABEL)


def _pairs_sql() -> str:
    order = ", ".join(f"('{f}', {i})" for i, f in enumerate(CLEAN_FEATURES))
    return with_clean(
        f"""SELECT m.feature_1, m.feature_2, m.correlation, abs(m.correlation) AS abs_correlation
FROM m JOIN (VALUES {order}) p1(f, i) ON p1.f = m.feature_1 JOIN (VALUES {order}) p2(f, i) ON p2.f = m.feature_2
WHERE p1.i < p2.i AND abs(m.correlation) > 0.9""",
        f"m AS ({_corr_sql('flows_clean', CLEAN_FEATURES)})",
    )


@register("corr_pairs", _pairs_sql())
def q_corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.corr_pairs(flows_clean(spark, sf_dir), LABEL)


_OUTLIER_SQL = with_clean(
    """SELECT q.feature_name, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound,
  CAST(count(*) FILTER (WHERE lf.value < q1 - 1.5 * (q3 - q1) OR lf.value > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outlier_count,
  count(*) FILTER (WHERE lf.value < q1 - 1.5 * (q3 - q1) OR lf.value > q3 + 1.5 * (q3 - q1)) / count(*) * 100.0 AS outlier_percentage
FROM lf JOIN q ON lf.feature_name = q.feature_name GROUP BY q.feature_name, q1, q3""",
    f"lf AS ({long_sql('flows_clean', CLEAN_FEATURES)}), "
    "q AS (SELECT feature_name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM lf GROUP BY feature_name)",
)


@register("outliers_iqr", _OUTLIER_SQL)
def q_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.outliers_iqr(flows_clean(spark, sf_dir), CLEAN_FEATURES + ["absent_feature", LABEL])


_SKEW_CTE = (
    f"lf AS ({long_sql('flows_clean', CLEAN_FEATURES)}), "
    "sk AS (SELECT feature_name, CASE WHEN stddev_samp(value) = 0 THEN 0.0 WHEN count(value) >= 3 THEN skewness(value) END AS skewness "
    "FROM lf GROUP BY feature_name), "
    "skc AS (SELECT feature_name, skewness, abs(skewness) AS abs_skewness, "
    "CASE WHEN abs(skewness) <= 0.5 THEN 'Symmetric' WHEN abs(skewness) <= 1.0 THEN 'Moderately Skewed' ELSE 'Highly Skewed' END AS classification FROM sk)"
)


@register("skewness_class", with_clean("SELECT * FROM skc", _SKEW_CTE))
def q_skewness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.skewness_class(flows_clean(spark, sf_dir), LABEL)


@register("skew_counts", with_clean("SELECT classification, CAST(count(*) AS BIGINT) AS feature_count FROM skc GROUP BY 1", _SKEW_CTE))
def q_skew_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.skew_counts(S.skewness_class(flows_clean(spark, sf_dir), LABEL))


@register("topk_skew", with_clean("SELECT * FROM skc ORDER BY abs_skewness DESC, feature_name LIMIT 10", _SKEW_CTE))
def q_topk_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.topk_skew(S.skewness_class(flows_clean(spark, sf_dir), LABEL))


@register(
    "rep_feature_summary",
    with_clean(
        "SELECT feature_name, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std, "
        "CAST(count(DISTINCT value) AS BIGINT) AS unique_values FROM lf GROUP BY feature_name",
        f"lf AS ({long_sql('flows_clean', REP)})",
    ),
)
def q_rep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rep_feature_summary(flows_clean(spark, sf_dir), LABEL)


_HIST_SQL = with_clean(
    """SELECT g.feature_name, g.bin, vmin + (vmax - vmin) / 50 * g.bin AS bin_start, vmin + (vmax - vmin) / 50 * (g.bin + 1) AS bin_end,
  CAST(coalesce(cn.cnt, 0) AS BIGINT) AS count, vmax / (vmin + 1e-5) > 1000 AS log_scale
FROM (SELECT feature_name, vmin, vmax, CAST(unnest(range(0, 50)) AS BIGINT) AS bin FROM rng) g
LEFT JOIN (
  SELECT lf.feature_name, CAST(CASE WHEN vmax = vmin THEN 0 ELSE least(floor((value - vmin) * 50 / (vmax - vmin)), 49) END AS BIGINT) AS bin, count(*) AS cnt
  FROM lf JOIN rng ON lf.feature_name = rng.feature_name GROUP BY 1, 2
) cn ON cn.feature_name = g.feature_name AND cn.bin = g.bin""",
    f"lf AS ({long_sql('flows_clean', REP)}), rng AS (SELECT feature_name, min(value) AS vmin, max(value) AS vmax FROM lf GROUP BY 1)",
)


@register("histogram", _HIST_SQL)
def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.histogram(flows_clean(spark, sf_dir), REP)


_BOX_SQL = with_clean(
    """SELECT q.feature_name, q1, median, q3,
  min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  CAST(count(*) FILTER (WHERE NOT (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))) AS BIGINT) AS flier_count
FROM lf JOIN q ON lf.feature_name = q.feature_name GROUP BY q.feature_name, q1, median, q3""",
    f"lf AS ({long_sql('flows_clean', REP)}), "
    "q AS (SELECT feature_name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM lf GROUP BY 1)",
)


@register("boxplot_stats", _BOX_SQL)
def q_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.boxplot_stats(flows_clean(spark, sf_dir), REP)


@register("select_numeric", with_clean(f"SELECT {', '.join(CLEAN_FEATURES)} FROM flows_clean"))
def q_select_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows_clean(spark, sf_dir)
    from flowlens.functions.exprs import numeric_columns

    return df.select(*numeric_columns(df, exclude=(LABEL,)))



