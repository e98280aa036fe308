"""Registered queries: attribution rankings, top-k, joins, waterfall.

The attribution table is derived from ``embeddings``: one explained row per
vector, one feature per dimension, one class per label value; phi for class c
and feature j is the vector's value at dimension (j + c) mod D.  Every
aggregate is then exactly checkable in SQL, independent of any training.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import attribution as A
from flowlens.plans.registry import register
from flowlens.sources.tables import read_table

N_CLASSES = 10


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    per_class = emb.select(
        F.col("vec_id").alias("row_id"), "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(N_CLASSES - 1))).alias("class_idx")
    )
    cells = per_class.select("row_id", "label", "class_idx", "embedding", F.posexplode("embedding").alias("feature_idx", "x"))
    phi = F.element_at("embedding", ((F.col("feature_idx") + F.col("class_idx")) % F.size("embedding")) + 1).cast("double")
    return cells.select(
        "row_id",
        F.col("label").cast("bigint").alias("label"),
        F.col("class_idx").cast("bigint").alias("class_idx"),
        F.concat(F.lit("f"), F.lpad(F.col("feature_idx").cast("string"), 2, "0")).alias("feature_name"),
        F.col("feature_idx").cast("bigint").alias("feature_idx"),
        F.col("x").cast("double").alias("value"),
        phi.alias("phi"),
    )


def own_class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each explained row's attributions for its own class."""
    return attributions(spark, sf_dir).filter(F.col("class_idx") == F.col("label"))


def builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in built-in importance: share of mean |value| per feature."""
    from pyspark.sql import Window

    m = attributions(spark, sf_dir).filter(F.col("class_idx") == 0).groupBy("feature_name").agg(F.avg(F.abs("value")).alias("m"))
    return A.builtin_ranking(m.select("feature_name", (F.col("m") / F.sum("m").over(Window.partitionBy())).alias("importance")))


ATTR_CTE = f"""attr AS (
  SELECT vec_id AS row_id, CAST(label AS BIGINT) AS label, CAST(c.i AS BIGINT) AS class_idx,
    'f' || lpad(CAST(j.i AS VARCHAR), 2, '0') AS feature_name, CAST(j.i AS BIGINT) AS feature_idx,
    CAST(embedding[j.i + 1] AS DOUBLE) AS value, CAST(embedding[((j.i + c.i) % len(embedding)) + 1] AS DOUBLE) AS phi
  FROM embeddings CROSS JOIN range(0, {N_CLASSES}) c(i) CROSS JOIN range(0, 64) j(i) WHERE j.i < len(embedding)),
own AS (SELECT * FROM attr WHERE class_idx = label),
pcm AS (SELECT class_idx, feature_name, avg(abs(phi)) AS mean_abs_shap FROM attr GROUP BY 1, 2),
pcr AS (SELECT class_idx, CAST(row_number() OVER (PARTITION BY class_idx ORDER BY mean_abs_shap DESC, feature_name) AS BIGINT) AS rank, feature_name, mean_abs_shap FROM pcm),
glb AS (SELECT CAST(row_number() OVER (ORDER BY mean_abs_shap DESC, feature_name) AS BIGINT) AS rank, feature_name, mean_abs_shap
  FROM (SELECT feature_name, avg(mean_abs_shap) AS mean_abs_shap FROM pcm GROUP BY 1)),
bim AS (SELECT feature_name, m / sum(m) OVER () AS importance FROM (SELECT feature_name, avg(abs(value)) AS m FROM attr WHERE class_idx = 0 GROUP BY 1)),
bir AS (SELECT feature_name, importance, CAST(row_number() OVER (ORDER BY importance DESC, feature_name) AS BIGINT) AS builtin_rank FROM bim),
jn AS (SELECT g.rank, g.feature_name, g.mean_abs_shap, b.importance, b.builtin_rank FROM glb g JOIN bir b ON g.feature_name = b.feature_name)"""


def sql(body: str) -> str:
    return f"WITH {ATTR_CTE}\n{body}"


@register("shap_global", sql("SELECT * FROM glb"))
def q_shap_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.global_importance(attributions(spark, sf_dir))


@register("rank_global", sql("SELECT rank, feature_name FROM glb"))
def q_rank_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.global_importance(attributions(spark, sf_dir)).select("rank", "feature_name")


@register("shap_per_class", sql("SELECT * FROM pcr"))
def q_shap_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.class_importance(attributions(spark, sf_dir))


@register("rank_per_class", sql("SELECT class_idx, rank, feature_name FROM pcr"))
def q_rank_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.class_importance(attributions(spark, sf_dir)).select("class_idx", "rank", "feature_name")


@register("rank_builtin", sql("SELECT * FROM bir"))
def q_rank_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builtin(spark, sf_dir)


@register("join_importance", sql("SELECT * FROM jn"))
def q_join_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.join_importance(A.global_importance(attributions(spark, sf_dir)), builtin(spark, sf_dir))


@register("topk_importance", sql("SELECT * FROM bir WHERE builtin_rank <= 20"))
def q_topk_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_builtin(builtin(spark, sf_dir))


@register("topk_global", sql("SELECT * FROM glb WHERE rank <= 20"))
def q_topk_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_global(A.global_importance(attributions(spark, sf_dir)))


@register("topk_class", sql("SELECT * FROM pcr WHERE rank <= 10"))
def q_topk_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_class(A.class_importance(attributions(spark, sf_dir)))


@register("topk_compare", sql("SELECT * FROM jn WHERE rank <= 15"))
def q_topk_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_compare(A.join_importance(A.global_importance(attributions(spark, sf_dir)), builtin(spark, sf_dir)))


@register("shap_row_mean", sql("SELECT row_id, feature_name, avg(abs(phi)) AS mean_abs_shap FROM attr GROUP BY 1, 2"))
def q_shap_row_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.row_mean_abs(attributions(spark, sf_dir))


_REP = "reps AS (SELECT CAST(label AS BIGINT) AS class_idx, min(vec_id) AS row_id FROM embeddings GROUP BY 1)"


@register(
    "shap_representative",
    f"WITH {ATTR_CTE}, {_REP}\nSELECT a.class_idx, a.row_id, feature_name, feature_idx, value, phi "
    "FROM attr a JOIN reps r ON a.class_idx = r.class_idx AND a.row_id = r.row_id",
)
def q_shap_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("bigint").alias("class_idx"))
    return A.representative(attributions(spark, sf_dir), emb)


def class_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in base value per class: the class share of the explained rows."""
    from pyspark.sql import Window

    emb = read_table(spark, sf_dir, "embeddings")
    cnt = emb.groupBy(F.col("label").cast("bigint").alias("class_idx")).agg(F.count(F.lit(1)).alias("n"))
    return cnt.select("class_idx", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("base_value"))


_WF = f"""WITH {ATTR_CTE}, {_REP},
base AS (SELECT CAST(label AS BIGINT) AS class_idx, count(*) / sum(count(*)) OVER () AS base_value FROM embeddings GROUP BY 1),
rp AS (SELECT a.* FROM attr a JOIN reps r ON a.class_idx = r.class_idx AND a.row_id = r.row_id)
SELECT rp.row_id, rp.class_idx,
  CAST(row_number() OVER (PARTITION BY rp.row_id, rp.class_idx ORDER BY abs(phi) DESC, feature_idx) AS BIGINT) AS step,
  feature_name, phi, base_value,
  base_value + sum(phi) OVER (PARTITION BY rp.row_id, rp.class_idx ORDER BY abs(phi) DESC, feature_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative
FROM rp JOIN base ON base.class_idx = rp.class_idx"""


@register("shap_waterfall", _WF)
def q_shap_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("bigint").alias("class_idx"))
    rows = A.representative(attributions(spark, sf_dir), emb)
    return A.waterfall(rows, class_prior(spark, sf_dir))


@register(
    "topk_attr_row",
    sql(
        "SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY abs(phi) DESC, feature_idx) AS BIGINT) AS position, "
        "feature_name, value, phi FROM own"
    ),
)
def q_topk_attr_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.topk_attr_row(own_class_rows(spark, sf_dir))


@register("filter_sign", sql("SELECT row_id, class_idx, feature_name, feature_idx, value, phi, label FROM own WHERE phi >= 0"))
def q_filter_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.filter_sign(own_class_rows(spark, sf_dir), positive=True)


_SIGNED = """SELECT row_id, position, sign, sign_rank, feature_name, phi, bar_width FROM (
  SELECT row_id, CAST(position AS BIGINT) AS position, CASE WHEN phi >= 0 THEN 'positive' ELSE 'negative' END AS sign,
    CAST(CASE WHEN sign_rank <= 5 THEN sign_rank END AS BIGINT) AS sign_rank, feature_name, phi,
    CASE WHEN position <= 10 THEN least(greatest(100.0 * abs(phi) / greatest(0.001, max(CASE WHEN position <= 10 THEN abs(phi) END) OVER (PARTITION BY row_id)), 4.0), 100.0) END AS bar_width,
    sign_rank AS sr
  FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(phi) DESC, feature_idx) AS position,
      row_number() OVER (PARTITION BY row_id, phi >= 0 ORDER BY abs(phi) DESC, feature_idx) AS sign_rank FROM own))
WHERE sr <= 5 OR position <= 10"""


@register("topk_signed", sql(_SIGNED))
def q_topk_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.topk_signed(own_class_rows(spark, sf_dir))
