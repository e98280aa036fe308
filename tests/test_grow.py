"""Trees grown in passes over binned rows: equal to Spark's, all classes and all bags in the same passes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import explain as X
from flowlens.operators import grow as G
from flowlens.operators import train as T

PARAMS = {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.9}


def rows(spark, classes, n=900):
    rnd = random.Random(classes)
    data = [(rnd.random(), float(rnd.randrange(5)), rnd.gauss(0, 1)) for _ in range(n)]
    data = [(*r, int((r[0] + 0.3 * r[1] + 0.2 * rnd.random()) * 100) % classes, 1.0 + (i % 3), f"k{i}") for i, r in enumerate(data)]
    return spark.createDataFrame(data, "a double, b double, c double, label_idx long, weight double, row_key string").repartition(3).localCheckpoint()


def nodes(spark, fitted):
    table = X.tree_table(spark, fitted).select(
        "model_idx", "tree_id", "id", "tree_weight", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split.featureIndex",
        F.array_join(F.col("split.leftCategoriesOrThreshold").cast("array<string>"), ",").alias("at"))
    return sorted((tuple(r) for r in table.collect()), key=lambda r: r[:3])


@pytest.mark.parametrize("state_rounds", [1, 10])
def test_boosted_trees_are_those_of_spark(spark, monkeypatch, state_rounds):
    monkeypatch.setattr(G, "STATE_ROUNDS", state_rounds)
    train = rows(spark, 3)
    new, old = (nodes(spark, f) for f in (T.gbt_train(train, ["a", "b", "c"], PARAMS), T.fit(train, ["a", "b", "c"], T.gbt_estimator(PARAMS), "ovr")))
    assert len(new) == len(old) > 50
    for x, y in zip(new, old):
        for u, v in zip(x, y):
            assert u == pytest.approx(v, rel=1e-9, abs=1e-12) if isinstance(u, (float, list)) else u == v


def jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_more_classes_take_no_more_passes(spark):
    few, many = rows(spark, 2), rows(spark, 7)
    one = jobs(spark, "few classes", lambda: T.gbt_train(few, ["a", "b", "c"], PARAMS))
    assert jobs(spark, "many classes", lambda: T.gbt_train(many, ["a", "b", "c"], PARAMS)) <= one + 6


def test_more_bagged_trees_take_no_more_passes(spark):
    train = rows(spark, 3)
    params = {"n_estimators": 2, "max_depth": 3, "max_features": "sqrt"}
    one = jobs(spark, "few trees", lambda: T.rf_oob(train, ["a", "b", "c"], params))
    assert jobs(spark, "many trees", lambda: T.rf_oob(train, ["a", "b", "c"], dict(params, n_estimators=12))) <= one + 6


def test_a_bagged_tree_over_all_features_is_that_of_spark(spark):
    train, features, n = rows(spark, 3), ["a", "b", "c"], 2
    params = {"max_depth": 3, "max_features": "all"}
    rows_, grown, models = T.bagged_trees(train, features, params, n, "label_idx", "weight", "row_key")
    vectors = T.assembler(features).transform(train)
    for t, model in enumerate(models):
        # 900 rows are taken whole for the candidates: give Spark the same ones, with weight 0 outside the bag
        weight = T.poisson_weight(F.col("row_key"), t) * F.col("weight")
        forest = T.rf_estimator(dict(params, n_estimators=1), "label_idx", None).setBootstrap(False).setWeightCol("w")
        bag = vectors.withColumn("w", weight).filter("w > 0")
        want = forest.fit(bag).transform(bag).select(F.avg((F.col("prediction") == F.col("label_idx")).cast("double"))).first()[0]
        got = model.transform(bag).select(F.avg((F.col("prediction") == F.col("label_idx")).cast("double"))).first()[0]
        assert math.isclose(got, want, abs_tol=0.05)
        root = grown[t].stats[0]
        sums = {r["label_idx"]: r["w"] for r in bag.groupBy("label_idx").agg(F.sum("w").alias("w")).collect()}
        assert [sums.get(k, 0.0) for k in range(3)] == pytest.approx(list(root[:-1])) and root[-1] == bag.count()


def test_predictions_are_those_of_the_python_model(spark):
    train = rows(spark, 3)
    fitted = T.gbt_train(train, ["a", "b", "c"], PARAMS)
    got = T.transform(fitted, train).select("row_key", "rawPrediction", "prediction").orderBy("row_key").collect()
    assert got == fitted.model.transform(train).select("row_key", "rawPrediction", "prediction").orderBy("row_key").collect()


def test_missing_values_are_refused(spark):
    bad = rows(spark, 2).withColumn("a", F.when(F.col("row_key") != "k5", F.col("a")))
    with pytest.raises(Exception, match="(?i)nan|missing"):
        T.gbt_train(bad, ["a", "b", "c"], PARAMS)
