"""The explanation queries explain every cleaned flow; looked-up path weights equal the recursion."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import explain as X

from conftest import SF_SMALL
from test_distributed_shap import NODES, node_rows


def deep_tree(seed, depth=6, p=5, k=3):
    rng = np.random.default_rng(seed)
    inner, size = 2**depth - 1, 2 ** (depth + 1) - 1
    left = np.where(np.arange(size) < inner, 2 * np.arange(size) + 1, -1)
    cover = np.zeros(size)
    cover[inner:] = rng.integers(1, 30, size - inner)
    for j in reversed(range(inner)):
        cover[j] = cover[2 * j + 1] + cover[2 * j + 2]
    feature = np.where(left >= 0, rng.integers(0, p, size), -1)
    return X.Tree(feature, rng.random(size), left, np.where(left >= 0, left + 1, -1), cover, rng.random((size, k)))


@pytest.mark.parametrize("bits", [10, 3])  # with three bits some trees are left to the recursion
def test_tables_equal_the_recursion(monkeypatch, bits):
    monkeypatch.setattr(X, "PATH_BITS", bits)
    monkeypatch.setattr(X, "CHUNK_ROWS", 64)
    leaf = X.Tree(np.array([-1]), np.zeros(1), np.array([-1]), np.array([-1]), np.ones(1), np.ones((1, 3)))
    trees = [deep_tree(1), deep_tree(2, depth=3), deep_tree(3, depth=2), leaf]
    x = np.random.default_rng(5).random((150, 5))
    np.testing.assert_allclose(X.tree_shap_tables(x, [(t, X._table(t)) for t in trees]), X.tree_shap_batch(x, trees), atol=1e-12)


@pytest.mark.parametrize("group_nodes", [10, 10_000])
def test_own_class_equals_the_long_table(spark, group_nodes):
    ensemble = X.load_trees(spark.createDataFrame(node_rows("rf"), NODES), "rf", 3, group_nodes=group_nodes)
    x = np.random.default_rng(4).random((300, 3))
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double, c double")
    scored = rows.withColumn("pred_idx", F.col("row_id") % 3).withColumn("confidence", F.lit(0.5))
    base = X.base_values(spark, ensemble)
    want = X.explain_rows(scored, X.shap_values(rows, ["a", "b", "c"], ensemble), base)
    got = X.explain_own(X.shap_own(scored, ["a", "b", "c"], ensemble), ["a", "b", "c"], base)
    assert got.columns == want.columns and got.count() == 300
    assert sorted(got.collect()) == sorted(want.collect())


def test_every_cleaned_flow_is_explained(spark):
    from flowlens.plans import q_model, q_quality
    from flowlens.plans.fixtures import CLEAN_FEATURES

    n = q_quality.flows_clean(spark, SF_SMALL).count()
    assert n > q_model.EXPLAIN_SAMPLE
    explained = q_model.q_explain_rows(spark, SF_SMALL).select("row_id", F.size("top_features").alias("p")).collect()
    assert sorted(r["row_id"] for r in explained) == list(range(n)) and {r["p"] for r in explained} == {len(CLEAN_FEATURES)}
    k = q_model.classes(spark, SF_SMALL).count()
    phi = q_model.q_shap_values(spark, SF_SMALL).agg(F.count("phi").alias("cells"), F.count_distinct("row_id").alias("rows")).first()
    assert (phi["rows"], phi["cells"]) == (n, n * k * len(CLEAN_FEATURES))
