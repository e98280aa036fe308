"""Registered queries: training, search, importances, tree table, attributions, model scoring.

Rows-only checks (no SQL oracle can train a forest); the invariants are tested
in ``tests/`` (additivity of attributions, brute-force Shapley on small trees).
Model sizes here are sized for the sf0.01 checks; the reference's grids and
defaults are the ``RF_GRID`` / ``GBT_DEFAULTS`` constants of ``operators.train``.
"""

from __future__ import annotations

import json

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.exprs import argmax_index
from flowlens.operators import attribution as A
from flowlens.operators import evaluate as E
from flowlens.operators import explain as X
from flowlens.operators import prepare as P
from flowlens.operators import score as SC
from flowlens.operators import train as T
from flowlens.plans.fixtures import CLEAN_FEATURES
from flowlens.plans.q_eval import classes
from flowlens.plans.q_prepare import flows_enc
from flowlens.plans.q_score import uploaded_rows
from flowlens.plans.registry import register
from flowlens.plans.stages import resettable, stage

RF_PARAMS = {"n_estimators": 20, "max_depth": 8, "min_samples_leaf": 1, "max_features": "sqrt"}
GBT_PARAMS = {"n_estimators": 5, "max_depth": 4, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.9}
SEARCH_GRID = {"n_estimators": [5, 10], "max_depth": [4, 8], "min_samples_leaf": [1, 2], "max_features": ["sqrt"]}
EXPLAIN_SAMPLE = 1000
_MODELS: dict = resettable({})


def weighted_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = flows_enc(spark, sf_dir)
    train = enc.filter(F.col("split") == "train")
    return P.with_weights(train, P.class_weights(train))


def fitted(spark: SparkSession, sf_dir: str, kind: str) -> T.Fitted:
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _MODELS:
        train = weighted_train(spark, sf_dir)
        if kind == "rf":
            _MODELS[key] = T.rf_train(train, CLEAN_FEATURES, RF_PARAMS)
        else:
            _MODELS[key] = T.gbt_train(train, CLEAN_FEATURES, GBT_PARAMS)
    return _MODELS[key]


def split_rows(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    return flows_enc(spark, sf_dir).filter(F.col("split") == split)


@register("rf_train")
def q_rf_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted forest fitted on the train split: its impurity importances."""
    return T.importance_frame(spark, fitted(spark, sf_dir, "rf"))


@register("gbt_train")
def q_gbt_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-vs-rest boosted trees: predictions on the test split."""
    pred = T.predict(fitted(spark, sf_dir, "ovr"), split_rows(spark, sf_dir, "test"))
    return pred.select("label_idx", "pred_idx", "confidence", "probability")


@register("feature_importance")
def q_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean importance over the one-vs-rest models, ranked."""
    return A.builtin_ranking(T.importance_frame(spark, fitted(spark, sf_dir, "ovr")))


@register("eval_model")
def q_eval_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest metrics on valid and test, with inference time of a ``noop`` write."""
    import time

    f = fitted(spark, sf_dir, "rf")
    cls = classes(spark, sf_dir)
    parts = []
    for split in ("valid", "test"):
        scored = T.predict(f, split_rows(spark, sf_dir, split))
        t0 = time.perf_counter()
        scored.write.format("noop").mode("overwrite").save()
        secs = time.perf_counter() - t0
        conf = E.confusion(scored, cls)
        pc = E.metrics_per_class(conf)
        auc = E.auc_ovr(E.auc_per_class(E.score_points(scored, cls)))
        parts.append(E.metrics_long(E.metrics_overall(pc), auc.withColumn("inference_time_seconds", F.lit(secs)), "rf", split))
    return parts[0].unionByName(parts[1])


@register("random_search")
def q_random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded random search (5 draws) with 3 stratified folds on a stratified tuning sample."""

    def build() -> DataFrame:
        train = weighted_train(spark, sf_dir).drop("weight")
        tune = P.kfold_stratified(P.stratified_sample(train, T.TUNING_SIZE, "label"), "label", T.SEARCH_FOLDS)
        return P.with_weights(tune, P.class_weights(tune))

    tune = stage(spark, "tuning_sample", sf_dir, build)
    best, score, secs = T.random_search(tune, CLEAN_FEATURES, SEARCH_GRID, "rf", fold_col="fold", n_iter=T.SEARCH_ITERATIONS)
    return spark.createDataFrame(
        [(json.dumps(best), score, secs, T.SEARCH_ITERATIONS, T.SEARCH_FOLDS)],
        "best_params string, best_cv_macro_f1 double, tuning_seconds double, n_iter int, n_folds int",
    )


def model_trees(spark: SparkSession, sf_dir: str, kind: str) -> X.Ensemble:
    key = (spark.sparkContext.applicationId, sf_dir, kind + "-trees")
    if key not in _MODELS:
        _MODELS[key] = X.load_trees(X.tree_table(spark, fitted(spark, sf_dir, kind)), kind, classes(spark, sf_dir).count())
    return _MODELS[key]


def forest_trees(spark: SparkSession, sf_dir: str) -> X.Ensemble:
    return model_trees(spark, sf_dir, "rf")


@register("tree_table")
def q_tree_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.tree_table(spark, fitted(spark, sf_dir, "rf"))


def explained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified 1 000-row sample of the test split with a row id, written once: every query sees the same ids."""

    def build() -> DataFrame:
        test = split_rows(spark, sf_dir, "test").drop("split")
        return SC.row_numbers(P.stratified_sample(test, EXPLAIN_SAMPLE, "label"), name="row_id")

    return stage(spark, "explained_rows", sf_dir, build)


def every_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cleaned flows; ``row_id`` is the row number of the scoring queries."""
    return uploaded_rows(spark, sf_dir).withColumnRenamed("row", "row_id")


@register("shap_values")
def q_shap_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions of every cleaned flow."""
    return X.shap_values(every_row(spark, sf_dir), CLEAN_FEATURES, forest_trees(spark, sf_dir))


@register("shap_base")
def q_shap_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.base_values(spark, forest_trees(spark, sf_dir))


@register("shap_additivity")
def q_shap_additivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row and class: base + sum(phi) next to the forest's probability (should agree to 1e-9)."""
    rows = explained_rows(spark, sf_dir)
    attr = X.shap_values(rows, CLEAN_FEATURES, forest_trees(spark, sf_dir))
    sums = attr.groupBy("row_id", "class_idx").agg(F.sum("phi").alias("sum_phi"))
    scored = T.predict(fitted(spark, sf_dir, "rf"), rows).select("row_id", F.posexplode("probability").alias("class_idx", "probability"))
    return (
        sums.join(X.base_values(spark, forest_trees(spark, sf_dir)), "class_idx")
        .join(scored, ["row_id", "class_idx"])
        .select("row_id", "class_idx", (F.col("base_value") + F.col("sum_phi")).alias("explained"), "probability")
    )


@register("tree_table_boosted")
def q_tree_table_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.tree_table(spark, fitted(spark, sf_dir, "ovr"))


@register("shap_values_boosted")
def q_shap_values_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions of each class's margin of the boosted model."""
    return X.shap_values(explained_rows(spark, sf_dir), CLEAN_FEATURES, model_trees(spark, sf_dir, "ovr"))


@register("shap_base_boosted")
def q_shap_base_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.base_values(spark, model_trees(spark, sf_dir, "ovr"))


@register("shap_additivity_error", "SELECT 0.0::DOUBLE AS forest_error, 0.0::DOUBLE AS boosted_error")
def q_shap_additivity_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest |base + sum(phi) - output| over rows and classes, to six places: probability (forest), margin (boosted)."""
    rows = explained_rows(spark, sf_dir)
    parts = []
    for kind in ("rf", "ovr"):
        model = fitted(spark, sf_dir, kind).model
        output = vector_to_array(F.col("probability" if kind == "rf" else "rawPrediction"))
        want = model.transform(rows).select("row_id", F.posexplode(output).alias("class_idx", "output"))
        trees = model_trees(spark, sf_dir, kind)
        sums = X.shap_values(rows, CLEAN_FEATURES, trees).groupBy("row_id", "class_idx").agg(F.sum("phi").alias("phi"))
        error = F.abs(F.col("base_value") + F.col("phi") - F.col("output"))
        joined = sums.join(X.base_values(spark, trees), "class_idx").join(want, ["row_id", "class_idx"])
        parts.append(joined.select(F.lit(kind).alias("kind"), error.alias("error")))
    worst = lambda kind: F.round(F.max(F.when(F.col("kind") == kind, F.col("error"))), 6)
    return parts[0].unionByName(parts[1]).agg(worst("rf").alias("forest_error"), worst("ovr").alias("boosted_error"))


@register("explain_maps")
def q_explain_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows given as feature maps (one feature left out, an infinite one kept) explained by the boosted model."""
    rows = explained_rows(spark, sf_dir)
    given = [f for f in CLEAN_FEATURES if f != "syn_flag_count"]
    maps = rows.select("row_id", F.create_map(*[x for f in given for x in (F.lit(f), F.col(f))]).alias("features"))
    maps = maps.withColumn("features", F.map_concat("features", F.create_map(F.lit("unknown"), F.lit(float("inf")))))
    f, trees = fitted(spark, sf_dir, "ovr"), model_trees(spark, sf_dir, "ovr")
    filled = X.rows_from_maps(maps, CLEAN_FEATURES)
    explained = X.explain_rows(T.predict(f, filled), X.shap_values(filled, CLEAN_FEATURES, trees), X.base_values(spark, trees))
    return SC.join_label_map(explained, classes(spark, sf_dir), "predicted_idx").select("row_id", "prediction", "confidence", "base_value", "top_features")


@register("explain_rows")
def q_explain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cleaned flow explained by the forest."""
    trees = forest_trees(spark, sf_dir)
    scored = T.predict(fitted(spark, sf_dir, "rf"), every_row(spark, sf_dir))
    return X.explain_own(X.shap_own(scored, CLEAN_FEATURES, trees), CLEAN_FEATURES, X.base_values(spark, trees))


@register("shap_metrics")
def q_shap_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explained_rows(spark, sf_dir)
    attr = X.shap_values(rows, CLEAN_FEATURES, forest_trees(spark, sf_dir))
    cls = classes(spark, sf_dir)
    glob = A.global_importance(attr)
    per = A.class_importance(attr, cls)
    builtin = A.builtin_ranking(T.importance_frame(spark, fitted(spark, sf_dir, "rf")))
    names = [r["label"] for r in cls.orderBy("idx").collect()]  # K class names
    return X.shap_metrics(glob, per, A.join_importance(glob, builtin), EXPLAIN_SAMPLE, len(CLEAN_FEATURES), names)


@register("score_batch_model")
def q_score_batch_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch scoring of all cleaned flows with the fitted forest (row, prediction, confidence); rows as in ``score_batch``."""
    f = fitted(spark, sf_dir, "rf")
    rows = uploaded_rows(spark, sf_dir)

    def proba(x: DataFrame):
        return T.probability_column("rf")

    x = SC.impute_zero(SC.select_features_ordered(rows, CLEAN_FEATURES, keep=["row"]), CLEAN_FEATURES)
    scored = f.model.transform(x).withColumn("_p", proba(x))
    scored = scored.withColumn("pred_idx", argmax_index(F.col("_p"))).withColumn("confidence", F.bround(F.array_max("_p"), SC.CONFIDENCE_DIGITS))
    return SC.join_label_map(scored, classes(spark, sf_dir)).select("row", "prediction", "confidence")


@register("rf_oob")
def q_rf_oob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-bag accuracy of a hashed-Poisson bagged forest on the train split."""
    from flowlens.functions.exprs import row_hash

    train = weighted_train(spark, sf_dir)
    train = train.withColumn("row_key", row_hash(train, ["label"] + CLEAN_FEATURES))
    summary, _ = T.rf_oob(train, CLEAN_FEATURES, RF_PARAMS)
    return summary


@register("sink_attributions")
def q_sink_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions and base values written as Parquet and read back (row counts per class)."""
    from flowlens.session import scratch_dir

    path = scratch_dir(spark, "attributions")
    X.shap_values(explained_rows(spark, sf_dir), CLEAN_FEATURES, forest_trees(spark, sf_dir)).write.mode("overwrite").partitionBy("class_idx").parquet(f"{path}/phi")
    X.base_values(spark, forest_trees(spark, sf_dir)).write.mode("overwrite").parquet(f"{path}/base")
    phi = spark.read.parquet(f"{path}/phi")
    return phi.groupBy("class_idx").agg(F.count(F.lit(1)).cast("bigint").alias("rows")).join(spark.read.parquet(f"{path}/base"), "class_idx")


@register("sink_artifacts")
def q_sink_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label map, class weights and the fitted model written with Spark's writers, read back."""
    from pyspark.ml import PipelineModel

    from flowlens.session import scratch_dir

    path = scratch_dir(spark, "artifacts")
    cls = classes(spark, sf_dir)
    train = split_rows(spark, sf_dir, "train")
    cls.write.mode("overwrite").parquet(f"{path}/label_mapping")
    P.class_weights(train).write.mode("overwrite").parquet(f"{path}/class_weights")
    fitted(spark, sf_dir, "rf").model.write().overwrite().save(f"{path}/model")
    reloaded = PipelineModel.load(f"{path}/model")
    n_stages = len(reloaded.stages)
    m = spark.read.parquet(f"{path}/label_mapping").withColumnRenamed("idx", "label_idx")
    return m.join(spark.read.parquet(f"{path}/class_weights"), "label_idx").withColumn("model_stages", F.lit(n_stages))
