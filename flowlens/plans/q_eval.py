"""Registered queries: evaluation, curves, reports, model comparison.

Two deterministic rule scorers over the cleaned flows play "model A" and
"model B", so every metric has an exact oracle without training.  The scorer
gives each class a small positive integer weight from the row's features and
normalises: ties in scores and predictions occur, as with real models.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import compare as CMP
from flowlens.operators import evaluate as E
from flowlens.operators import prepare as P
from flowlens.plans.q_prepare import flows_enc
from flowlens.plans.fixtures import LABEL
from flowlens.plans.registry import register
from flowlens.plans.stages import stage
from flowlens.plans.sqltext import with_prepared

K = 5

# (spark expression text, identical in DuckDB) for each class weight of the two scorers
RULES = {
    "A": [
        "1 + destination_port % 5",
        "1 + syn_flag_count * 2",
        "1 + floor(flow_duration / 10)",
        "1 + floor(down_up_ratio * 50)",
        "1 + floor(fwd_iat_std * 50)",
    ],
    "B": [
        "1 + destination_port % 7",
        "2 + syn_flag_count",
        "1 + floor(flow_duration / 8)",
        "1 + floor(down_up_ratio * 40)",
        "1 + floor(avg_packet_size / 20)",
    ],
}


def rule_probability(model: str) -> Column:
    ws = [F.expr(f"CAST({r} AS DOUBLE)") for r in RULES[model]]
    total = ws[0]
    for w in ws[1:]:
        total = total + w
    return F.array(*[w / total for w in ws])


def scored(spark: SparkSession, sf_dir: str, model: str, split: str) -> DataFrame:
    rows = flows_enc(spark, sf_dir).filter(F.col("split") == split)
    return E.add_prediction(rows.withColumn(E.PROBA, rule_probability(model)))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label map, read once from the written split table."""
    return stage(spark, "label_map", sf_dir, lambda: P.label_mapping(flows_enc(spark, sf_dir), LABEL))


class Evaluation:
    """What one model's predictions on one split are judged by; every part is built when it is first asked for.

    The (class, score) points are written once and shared by the AUC and both curves.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, model: str, split: str):
        self.spark, self.sf_dir, self.model, self.split = spark, sf_dir, model, split

    def __getitem__(self, part: str) -> DataFrame:
        return getattr(self, part)

    @cached_property
    def scored(self) -> DataFrame:
        return scored(self.spark, self.sf_dir, self.model, self.split)

    @cached_property
    def classes(self) -> DataFrame:
        return classes(self.spark, self.sf_dir)

    @cached_property
    def conf(self) -> DataFrame:
        return E.confusion(self.scored, self.classes)

    @cached_property
    def per_class(self) -> DataFrame:
        return E.metrics_per_class(self.conf)

    @cached_property
    def overall(self) -> DataFrame:
        return E.metrics_overall(self.per_class)

    @cached_property
    def points(self) -> DataFrame:
        return stage(self.spark, f"points_{self.model}_{self.split}", self.sf_dir, lambda: E.score_points(self.scored, self.classes))

    @cached_property
    def auc(self) -> DataFrame:
        return stage(self.spark, f"auc_{self.model}_{self.split}", self.sf_dir, lambda: E.auc_per_class(self.points))

    @cached_property
    def auc_ovr(self) -> DataFrame:
        return E.auc_ovr(self.auc)


def evaluation(spark: SparkSession, sf_dir: str, model: str, split: str) -> Evaluation:
    return Evaluation(spark, sf_dir, model, split)


# ---------------------------------------------------------------- oracle SQL


def _eval_ctes(model: str, split: str) -> str:
    m = f"{model.lower()}_{split}"
    ws = [f"CAST({r} AS DOUBLE)" for r in RULES[model]]
    tot = " + ".join(ws)
    arr = "[" + ", ".join(f"({w}) / ({tot})" for w in ws) + "]"
    return f"""
sc_{m} AS (SELECT *, {arr} AS probability FROM flows_enc WHERE split = '{split}'),
pr_{m} AS (SELECT *, CAST(list_position(probability, list_max(probability)) - 1 AS BIGINT) AS pred_idx, list_max(probability) AS confidence FROM sc_{m}),
cf_{m} AS (SELECT g.t AS true_idx, g.p AS pred_idx, CAST(count(x.label_idx) AS BIGINT) AS count
  FROM (SELECT a.idx AS t, b.idx AS p FROM lmap a, lmap b) g LEFT JOIN pr_{m} x ON x.label_idx = g.t AND x.pred_idx = g.p GROUP BY 1, 2),
cc_{m} AS (SELECT i AS class_idx,
  (SELECT sum(count) FROM cf_{m} WHERE true_idx = i AND pred_idx = i) AS tp,
  (SELECT sum(count) FROM cf_{m} WHERE true_idx = i) AS support,
  (SELECT sum(count) FROM cf_{m} WHERE pred_idx = i) AS predicted FROM (SELECT idx AS i FROM lmap)),
pc_{m} AS (SELECT class_idx,
  CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1_score,
  CAST(support AS BIGINT) AS support FROM cc_{m} WHERE support > 0 OR predicted > 0),
ov_{m} AS (SELECT sum(recall * support) / sum(support) AS accuracy,
  avg(precision) AS precision_macro, sum(precision * support) / sum(support) AS precision_weighted,
  avg(recall) AS recall_macro, sum(recall * support) / sum(support) AS recall_weighted,
  avg(f1_score) AS f1_macro, sum(f1_score * support) / sum(support) AS f1_weighted FROM pc_{m}),
pt_{m} AS (SELECT CAST(r.i AS BIGINT) AS class_idx, probability[r.i + 1] AS score,
  CAST(count(*) FILTER (WHERE label_idx = r.i) AS BIGINT) AS pos, CAST(count(*) FILTER (WHERE label_idx <> r.i) AS BIGINT) AS neg
  FROM pr_{m} CROSS JOIN range(0, {K}) r(i) GROUP BY 1, 2),
cu_{m} AS (SELECT class_idx, score, pos, neg,
  sum(pos) OVER (PARTITION BY class_idx) AS "P", sum(neg) OVER (PARTITION BY class_idx) AS "N",
  coalesce(sum(pos) OVER (PARTITION BY class_idx ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_before,
  coalesce(sum(neg) OVER (PARTITION BY class_idx ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
  FROM pt_{m}),
cum_{m} AS (SELECT class_idx, score, pos, neg, "P", "N", "P" - pos_before AS tp, "N" - neg_before AS fp,
  "P" - pos_before - pos AS tp_above, "N" - neg_before - neg AS fp_above, pos_before, neg_before FROM cu_{m}),
auc_{m} AS (SELECT class_idx, CAST(sum(pos) AS BIGINT) AS "P", CAST(sum(neg) AS BIGINT) AS "N",
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN (2 * sum(pos * neg_before) + sum(pos * neg)) / (2.0 * sum(pos) * sum(neg)) ELSE 0.0 END AS roc_auc
  FROM cum_{m} GROUP BY class_idx),
aov_{m} AS (SELECT CASE WHEN min(CASE WHEN "P" > 0 AND "N" > 0 THEN 1 ELSE 0 END) = 1 THEN avg(roc_auc) ELSE 0.0 END AS roc_auc_macro,
  CASE WHEN min(CASE WHEN "P" > 0 AND "N" > 0 THEN 1 ELSE 0 END) = 1 THEN sum(roc_auc * "P") / sum("P") ELSE 0.0 END AS roc_auc_weighted FROM auc_{m})"""


def _ctes(*pairs: tuple[str, str]) -> str:
    return ",".join(_eval_ctes(m, s) for m, s in pairs)


def sql(body: str, *pairs: tuple[str, str]) -> str:
    return with_prepared(body, _ctes(*pairs))


A_TEST = ("A", "test")

# ---------------------------------------------------------------- evaluation


@register("confusion", sql("SELECT * FROM cf_a_test", A_TEST))
def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation(spark, sf_dir, "A", "test")["conf"]


@register("metrics_per_class", sql("SELECT * FROM pc_a_test", A_TEST))
def q_metrics_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation(spark, sf_dir, "A", "test")["per_class"]


@register("metrics_overall", sql("SELECT * FROM ov_a_test", A_TEST))
def q_metrics_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation(spark, sf_dir, "A", "test")["overall"]


@register("auc_per_class", sql("SELECT * FROM auc_a_test", A_TEST))
def q_auc_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation(spark, sf_dir, "A", "test")["auc"]


@register("auc_ovr", sql("SELECT * FROM aov_a_test", A_TEST))
def q_auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation(spark, sf_dir, "A", "test")["auc_ovr"]


@register(
    "curve_cumulative",
    sql('SELECT class_idx, score, pos, neg, "P", "N", tp, fp, tp_above, fp_above FROM cum_a_test', A_TEST),
)
def q_curve_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.curve_cumulative(evaluation(spark, sf_dir, "A", "test")["points"])


_ROC = """SELECT class_idx, score AS threshold, fp / "N" AS fpr, tp / "P" AS tpr,
  (fp / "N" - fp_above / "N") * (tp / "P" + tp_above / "P") / 2.0 AS segment_area FROM cum_a_test WHERE "P" > 0 AND "N" > 0"""
_PR = """SELECT class_idx, score AS threshold, tp / (tp + fp) AS precision, tp / "P" AS recall,
  (tp / "P" - tp_above / "P") * (tp / (tp + fp) + CASE WHEN tp_above + fp_above > 0 THEN tp_above / (tp_above + fp_above) ELSE 1.0 END) / 2.0 AS segment_area
  FROM cum_a_test WHERE "P" > 0"""


@register("roc_curve", sql(_ROC, A_TEST))
def q_roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.roc_curve(E.curve_cumulative(evaluation(spark, sf_dir, "A", "test")["points"]))


@register("pr_curve", sql(_PR, A_TEST))
def q_pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pr_curve(E.curve_cumulative(evaluation(spark, sf_dir, "A", "test")["points"]))


@register(
    "curve_area",
    sql(
        f"SELECT r.class_idx, r.roc_area, p.pr_area FROM (SELECT class_idx, sum(segment_area) AS roc_area FROM ({_ROC}) GROUP BY 1) r "
        f"JOIN (SELECT class_idx, sum(segment_area) AS pr_area FROM ({_PR}) GROUP BY 1) p ON r.class_idx = p.class_idx",
        A_TEST,
    ),
)
def q_curve_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    cum = E.curve_cumulative(evaluation(spark, sf_dir, "A", "test")["points"])
    return E.curve_area(E.roc_curve(cum), "roc_area").join(E.curve_area(E.pr_curve(cum), "pr_area"), "class_idx")


_REPORT = """SELECT m.label AS row_name, precision, recall, f1_score AS "f1-score", CAST(support AS DOUBLE) AS support
  FROM pc_a_test p JOIN lmap m ON m.idx = p.class_idx
UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, (SELECT CAST(sum(support) AS DOUBLE) FROM pc_a_test) FROM ov_a_test
UNION ALL SELECT 'macro avg', precision_macro, recall_macro, f1_macro, (SELECT CAST(sum(support) AS DOUBLE) FROM pc_a_test) FROM ov_a_test
UNION ALL SELECT 'weighted avg', precision_weighted, recall_weighted, f1_weighted, (SELECT CAST(sum(support) AS DOUBLE) FROM pc_a_test) FROM ov_a_test"""


@register("classification_report", sql(_REPORT, A_TEST))
def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = evaluation(spark, sf_dir, "A", "test")
    return E.classification_report(ev["per_class"], ev["classes"])


@register(
    "transpose_report",
    sql(
        "SELECT row_name, metric, value FROM (" + _REPORT + ') UNPIVOT (value FOR metric IN (precision, recall, "f1-score", support))',
        A_TEST,
    ),
)
def q_transpose_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = evaluation(spark, sf_dir, "A", "test")
    return E.transpose_report(E.classification_report(ev["per_class"], ev["classes"]))


CLASS_NAMES = ["BENIGN", "Bot", "DoS Hulk", "PortScan", "Web Attack"]


@register(
    "pivot_confusion",
    sql(
        "SELECT t.label AS true_label, "
        + ", ".join(f"CAST(sum(count) FILTER (WHERE p.label = '{n}') AS BIGINT) AS \"{n}\"" for n in CLASS_NAMES)
        + " FROM cf_a_test c JOIN lmap t ON t.idx = c.true_idx JOIN lmap p ON p.idx = c.pred_idx GROUP BY t.label",
        A_TEST,
    ),
)
def q_pivot_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = evaluation(spark, sf_dir, "A", "test")
    names = CLASS_NAMES
    return E.pivot_confusion(ev["conf"], ev["classes"], names)


# ---------------------------------------------------------------- comparison


def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for model in ("A", "B"):
        for split in ("test", "valid"):
            ev = evaluation(spark, sf_dir, model, split)
            parts.append(E.metrics_long(ev["overall"], ev["auc_ovr"], model, split))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def per_class_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ea = evaluation(spark, sf_dir, "A", "test")
    eb = evaluation(spark, sf_dir, "B", "test")
    return E.per_class_long(ea["per_class"], ea["auc"], ea["classes"], "A"), E.per_class_long(eb["per_class"], eb["auc"], eb["classes"], "B")


ALL4 = (("A", "test"), ("B", "test"), ("A", "valid"), ("B", "valid"))


#: Fixed stand-ins for measured times (model, split, metric, seconds), so that the oracle sees every metric row.
FIXED_TIMES = [
    ("A", "test", "training_time_seconds", 12.5), ("B", "test", "training_time_seconds", 40.0),
    ("A", "test", "inference_time_seconds", 0.25), ("B", "test", "inference_time_seconds", 0.625),
    ("A", "valid", "inference_time_seconds", 0.2), ("B", "valid", "inference_time_seconds", 0.75),
]


def fixed_times(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXED_TIMES, "model string, split string, metric string, value double")


_TIMES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{s}', '{k}', {v}::DOUBLE)" for m, s, k, v in FIXED_TIMES) + ") t(model, split, metric, value)"


def _long_sql() -> str:
    parts = []
    for model, split in ALL4:
        m = f"{model.lower()}_{split}"
        cols = ["accuracy", "precision_macro", "precision_weighted", "recall_macro", "recall_weighted", "f1_macro", "f1_weighted"]
        sel = " UNION ALL ".join(f"SELECT '{model}' AS model, '{split}' AS split, '{c}' AS metric, {c} AS value FROM ov_{m}" for c in cols)
        sel += " UNION ALL " + " UNION ALL ".join(
            f"SELECT '{model}', '{split}', '{c}', {c} FROM aov_{m}" for c in ["roc_auc_macro", "roc_auc_weighted"]
        )
        parts.append(sel)
    return "measured AS (" + " UNION ALL ".join(parts) + ")"


def _cmp_sql(body: str, extra: str = "") -> str:
    ctes = _ctes(*ALL4) + ",\n" + _long_sql() + f",\nml AS (SELECT * FROM measured UNION ALL {_TIMES_SQL})"
    names = ", ".join(f"('{k}', '{v}', {i})" for i, (v, k) in enumerate(CMP.METRIC_LABELS))
    ctes += f",\nlabels AS (SELECT * FROM (VALUES {names}) t(metric, label, ord))"
    ctes += """,
cmp AS (SELECT l.label AS metric,
  max(value) FILTER (WHERE model = 'A' AND split = 'test') AS a_test,
  max(value) FILTER (WHERE model = 'B' AND split = 'test') AS b_test,
  max(value) FILTER (WHERE model = 'B' AND split = 'test') - max(value) FILTER (WHERE model = 'A' AND split = 'test') AS difference_b_minus_a,
  max(value) FILTER (WHERE model = 'A' AND split = 'valid') AS a_valid,
  max(value) FILTER (WHERE model = 'B' AND split = 'valid') AS b_valid
  FROM ml JOIN labels l ON l.metric = ml.metric GROUP BY l.label)"""
    if extra:
        ctes += ",\n" + extra
    return with_prepared(body, ctes)


@register("compare_overall", _cmp_sql("SELECT * FROM cmp"))
def q_compare_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CMP.compare_overall(long_metrics(spark, sf_dir), fixed_times(spark))


_PER_CLASS_CTES = """
pca AS (SELECT m.label AS class_label, precision, recall, f1_score, coalesce(a.roc_auc, 0.0) AS roc_auc FROM pc_a_test p JOIN lmap m ON m.idx = p.class_idx LEFT JOIN auc_a_test a ON a.class_idx = p.class_idx),
pcb AS (SELECT m.label AS class_label, precision, recall, f1_score, coalesce(a.roc_auc, 0.0) AS roc_auc FROM pc_b_test p JOIN lmap m ON m.idx = p.class_idx LEFT JOIN auc_b_test a ON a.class_idx = p.class_idx),
pcc AS (SELECT coalesce(pca.class_label, pcb.class_label) AS class_label,
  coalesce(pca.precision, 0.0) AS a_precision, coalesce(pcb.precision, 0.0) AS b_precision,
  coalesce(pca.recall, 0.0) AS a_recall, coalesce(pcb.recall, 0.0) AS b_recall,
  coalesce(pca.f1_score, 0.0) AS a_f1, coalesce(pcb.f1_score, 0.0) AS b_f1,
  coalesce(pca.roc_auc, 0.0) AS a_roc_auc, coalesce(pcb.roc_auc, 0.0) AS b_roc_auc,
  coalesce(pcb.f1_score, 0.0) - coalesce(pca.f1_score, 0.0) AS f1_difference_b_minus_a
  FROM pca FULL OUTER JOIN pcb ON pca.class_label = pcb.class_label)"""


@register("compare_per_class", with_prepared("SELECT * FROM pcc", _ctes(A_TEST, ("B", "test")) + "," + _PER_CLASS_CTES))
def q_compare_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = per_class_tables(spark, sf_dir)
    return CMP.compare_per_class(a, b)


@register("join_per_class_full", with_prepared("SELECT * FROM pcc", _ctes(A_TEST, ("B", "test")) + "," + _PER_CLASS_CTES))
def q_join_per_class_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = per_class_tables(spark, sf_dir)
    return CMP.join_per_class_full(a, b)


@register(
    "set_all_classes",
    with_prepared(
        "SELECT class_label FROM pca UNION SELECT class_label FROM pcb", _ctes(A_TEST, ("B", "test")) + "," + _PER_CLASS_CTES
    ),
)
def q_set_all_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = per_class_tables(spark, sf_dir)
    return CMP.set_all_classes(a, b)


@register(
    "unpivot_metrics",
    _cmp_sql(
        "SELECT metric, 'Model A' AS model, a_test AS score FROM cmp UNION ALL SELECT metric, 'Model B', b_test FROM cmp"
    ),
)
def q_unpivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CMP.unpivot_metrics(CMP.compare_overall(long_metrics(spark, sf_dir), fixed_times(spark)))


_WIN = """SELECT
  CASE WHEN f.b_test > f.a_test THEN 'Model B' WHEN f.a_test > f.b_test THEN 'Model A' ELSE 'Tie' END AS highest_macro_f1_model,
  CASE WHEN f.b_test >= f.a_test THEN f.b_test ELSE f.a_test END AS highest_macro_f1_score,
  CASE WHEN f.b_test > f.a_test OR (f.b_test = f.a_test AND a.b_test >= a.a_test) THEN 'Model B' ELSE 'Model A' END AS best_overall_model,
  CASE WHEN t.a_test < t.b_test THEN 'Model A' ELSE 'Model B' END AS fastest_model,
  CASE WHEN t.a_test < t.b_test THEN t.b_test / t.a_test ELSE t.a_test / t.b_test END AS inference_speedup_factor,
  CASE WHEN abs(p.b_test - r.b_test) < abs(p.a_test - r.a_test) THEN 'Model B' ELSE 'Model A' END AS most_balanced_model,
  abs(p.a_test - r.a_test) AS a_precision_recall_gap,
  abs(p.b_test - r.b_test) AS b_precision_recall_gap
FROM (SELECT * FROM cmp WHERE metric = 'Macro F1') f, (SELECT * FROM cmp WHERE metric = 'Accuracy') a,
     (SELECT * FROM cmp WHERE metric = 'Macro Precision') p, (SELECT * FROM cmp WHERE metric = 'Macro Recall') r,
     (SELECT * FROM cmp WHERE metric = 'Test Inference Time (s)') t"""


@register("pick_winners", _cmp_sql(_WIN))
def q_pick_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CMP.pick_winners(CMP.compare_overall(long_metrics(spark, sf_dir), fixed_times(spark)))


@register("compare_overall_timed")
def q_compare_overall_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the two time rows: inference time of each scorer measured on a ``noop`` sink."""
    import time

    times = []
    for model in ("A", "B"):
        s = scored(spark, sf_dir, model, "test")
        t0 = time.perf_counter()
        s.write.format("noop").mode("overwrite").save()
        times.append((model, "test", "inference_time_seconds", time.perf_counter() - t0))
    t = spark.createDataFrame(times, "model string, split string, metric string, value double")
    return CMP.compare_overall(long_metrics(spark, sf_dir), t)


LONG_METRICS_SQL = with_prepared("SELECT * FROM measured", _ctes(*ALL4) + ",\n" + _long_sql())
