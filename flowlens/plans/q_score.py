"""Registered queries: batch scoring and result queries, feature maps, JSON, union."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.exprs import argmax_index, pct_guard
from flowlens.operators import reshape as R
from flowlens.operators import score as SC
from flowlens.plans.fixtures import CLEAN_FEATURES, FEATURES, LABEL
from flowlens.plans.q_eval import RULES, classes, rule_probability
from flowlens.plans.q_quality import flows_clean, flows_in
from flowlens.plans.registry import register
from flowlens.plans.stages import stage
from flowlens.plans.sqltext import hash_sql, with_prepared
from flowlens.sources.tables import read_table

COLS = [LABEL] + CLEAN_FEATURES


def uploaded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cleaned flows with a stable row number, written once: predictions and features share the numbers."""
    return stage(spark, "uploaded_rows", sf_dir, lambda: SC.row_numbers(flows_clean(spark, sf_dir)))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.score_batch(uploaded_rows(spark, sf_dir), CLEAN_FEATURES, lambda x: rule_probability("A"), classes(spark, sf_dir), row_col="row")


_WA = [f"CAST({r} AS DOUBLE)" for r in RULES["A"]]
_ARR = "[" + ", ".join(f"({w}) / ({' + '.join(_WA)})" for w in _WA) + "]"
_PRED_CTES = f"""
tst AS (SELECT *, CAST(row_number() OVER (ORDER BY {hash_sql(COLS)}) - 1 AS BIGINT) AS "row" FROM flows_clean),
tsp AS (SELECT "row", {_ARR} AS p FROM tst),
preds AS (SELECT "row", coalesce(m.label, 'Unknown_' || CAST(list_position(p, list_max(p)) - 1 AS VARCHAR)) AS prediction,
  round_even(list_max(p), 4) AS confidence FROM tsp LEFT JOIN lmap m ON m.idx = list_position(p, list_max(p)) - 1)"""


def sql(body: str, extra: str = "") -> str:
    return with_prepared(body, _PRED_CTES + ("," + extra if extra else ""))


@register("score_batch", sql('SELECT "row", prediction, confidence FROM preds'))
def q_score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir)


@register(
    "prediction_summary",
    sql(
        "SELECT CAST(count(*) AS BIGINT) AS total_samples, CAST(count(*) FILTER (WHERE upper(prediction) <> 'BENIGN') AS BIGINT) AS predicted_attacks, "
        "CAST(count(*) FILTER (WHERE upper(prediction) = 'BENIGN') AS BIGINT) AS predicted_benign FROM preds"
    ),
)
def q_prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.prediction_summary(predictions(spark, sf_dir))


@register(
    "attack_vector_count",
    sql(
        "SELECT CAST(count(DISTINCT prediction) FILTER (WHERE upper(prediction) <> 'BENIGN') AS BIGINT) AS attack_vectors, "
        "round(count(*) FILTER (WHERE upper(prediction) = 'BENIGN') / count(*) * 100.0, 1) AS benign_pct, "
        "round(count(*) FILTER (WHERE upper(prediction) <> 'BENIGN') / count(*) * 100.0, 1) AS attack_pct FROM preds"
    ),
)
def q_attack_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.attack_vector_count(predictions(spark, sf_dir))


@register("filter_category", sql("SELECT * FROM preds WHERE upper(prediction) <> 'BENIGN'"))
def q_filter_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.filter_category(predictions(spark, sf_dir), "attacks")


@register("search_predictions", sql("""SELECT * FROM preds WHERE contains(CAST("row" AS VARCHAR), '7') OR contains(lower(prediction), '7')"""))
def q_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.search_predictions(predictions(spark, sf_dir), "7")


@register("search_predictions_class", sql("SELECT * FROM preds WHERE contains(CAST(\"row\" AS VARCHAR), 'dos') OR contains(lower(prediction), 'dos')"))
def q_search_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.search_predictions(predictions(spark, sf_dir), "DoS")


@register("sort_predictions", sql('SELECT * FROM preds ORDER BY confidence DESC, "row"'))
def q_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.sort_predictions(predictions(spark, sf_dir), "confidence", descending=True)


@register("page_predictions", sql('SELECT * FROM preds ORDER BY lower(prediction) DESC, "row" LIMIT 25 OFFSET 50'))
def q_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.page_predictions(predictions(spark, sf_dir), page=3, size=25, field="prediction", descending=True)


@register(
    "lookup_row",
    sql(f'SELECT p."row", prediction, confidence, {", ".join("t." + c for c in COLS)} FROM preds p LEFT JOIN tst t ON p."row" = t."row"'),
)
def q_lookup_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.lookup_row(predictions(spark, sf_dir), uploaded_rows(spark, sf_dir))


_C_EXTRA = "CAST(CASE WHEN destination_port % 11 = 0 THEN 20 ELSE 0 END AS DOUBLE)"


@register(
    "join_label_map",
    sql(
        'SELECT "row", pred_idx, coalesce(m.label, \'Unknown_\' || CAST(pred_idx AS VARCHAR)) AS prediction FROM '
        f"(SELECT \"row\", CAST(list_position(list_append(p, {_C_EXTRA}), list_max(list_append(p, {_C_EXTRA}))) - 1 AS BIGINT) AS pred_idx "
        "FROM (SELECT t.\"row\", t.destination_port, s.p FROM tst t JOIN tsp s ON s.\"row\" = t.\"row\")) x LEFT JOIN lmap m ON m.idx = x.pred_idx"
    ),
)
def q_join_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A six-output scorer over five known classes: index 5 has no name."""
    rows = uploaded_rows(spark, sf_dir)
    p6 = F.concat(rule_probability("A"), F.array(F.expr(_C_EXTRA)))
    idx = rows.select("row", argmax_index(p6).alias("pred_idx"))
    return SC.join_label_map(idx, classes(spark, sf_dir)).select("row", "pred_idx", "prediction")


_MODEL_ORDER = list(reversed(CLEAN_FEATURES))


@register("select_features_ordered", with_prepared(f"SELECT {', '.join(_MODEL_ORDER)} FROM flows_clean"))
def q_select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.plans.q_quality import flows_clean

    return SC.select_features_ordered(flows_clean(spark, sf_dir), _MODEL_ORDER)


@register(
    "impute_zero",
    with_prepared(
        "SELECT label, "
        + ", ".join(f"CASE WHEN {f} IS NULL OR isnan({f}) OR isinf({f}) THEN 0.0 ELSE {f} END AS {f}" for f in FEATURES)
        + " FROM flows_in"
    ),
)
def q_impute_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.impute_zero(flows_in(spark, sf_dir), FEATURES)


@register(
    "fn_feature_map",
    "SELECT event_id, k.key AS key, CAST(json_extract(props, '$.' || k.key) AS DOUBLE) AS value "
    "FROM events, (SELECT unnest(json_keys(props)) AS key, event_id AS eid FROM events) k WHERE k.eid = events.event_id",
)
def q_feature_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").withColumn("features", R.feature_map("props"))
    return R.explode_map(ev, ["event_id"], "features")


@register(
    "pad_missing_features",
    "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS DOUBLE), 0.0) AS k, "
    "coalesce(CAST(json_extract(props, '$.flow_duration') AS DOUBLE), 0.0) AS flow_duration FROM events",
)
def q_pad_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", *SC.pad_missing_features(R.feature_map("props"), ["k", "flow_duration"]))


@register(
    "fn_argmax",
    "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS argmax_idx, "
    "CAST(list_max(embedding) AS DOUBLE) AS max_value FROM embeddings",
)
def q_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", argmax_index(F.col("embedding")).alias("argmax_idx"), F.array_max("embedding").cast("double").alias("max_value"))


@register(
    "fn_pct_guard",
    "SELECT quality, CASE WHEN count(*) FILTER (WHERE quality = 1) > 0 THEN sum(toxic) FILTER (WHERE quality = 1) / count(*) FILTER (WHERE quality = 1) * 100.0 ELSE 0.0 END AS toxic_pct_of_good, "
    "sum(toxic) / count(*) * 100.0 AS toxic_pct FROM labels GROUP BY quality",
)
def q_pct_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read_table(spark, sf_dir, "labels")
    good = F.col("quality") == 1
    return lab.groupBy("quality").agg(
        pct_guard(F.sum(F.when(good, F.col("toxic"))), F.count_if(good)).alias("toxic_pct_of_good"),
        pct_guard(F.sum("toxic"), F.count(F.lit(1))).alias("toxic_pct"),
    )


@register("fn_json_metrics")
def q_json_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics record -> JSON text -> record (round trip of the metrics sink format)."""
    s = SC.prediction_summary(predictions(spark, sf_dir))
    js = R.to_json_record(s, s.columns)
    return R.from_json_record(js, "total_samples bigint, predicted_attacks bigint, predicted_benign bigint")


@register(
    "union_outer",
    "SELECT c_custkey AS id, c_acctbal AS acctbal, c_nationkey AS nationkey, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS name FROM customer "
    "UNION ALL SELECT s_suppkey, s_acctbal, s_nationkey, NULL, s_name FROM supplier",
)
def q_union_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment")
    )
    supp = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name")
    )
    return R.union_outer([cust, supp])
