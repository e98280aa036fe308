"""Bagging weights behind the out-of-bag estimate follow Poisson(1) and are deterministic."""

import math

from pyspark.sql import functions as F

from flowlens.operators.train import poisson_weight, sample_grid

from conftest import SF_SMALL


def test_poisson_weights(spark):
    df = spark.range(200_000).select(F.col("id").cast("string").alias("k"))
    w = df.select(poisson_weight(F.col("k"), 3).alias("w"))
    stats = w.agg(F.avg("w").alias("mean"), F.avg((F.col("w") == 0).cast("double")).alias("p0"), F.variance("w").alias("var")).first()
    assert abs(stats["mean"] - 1.0) < 0.01
    assert abs(stats["p0"] - math.exp(-1)) < 0.005
    assert abs(stats["var"] - 1.0) < 0.02
    again = df.select(poisson_weight(F.col("k"), 3).alias("w"))
    assert w.collect()[:50] == again.collect()[:50]
    other = df.select(poisson_weight(F.col("k"), 4).alias("w")).collect()[:200]
    assert other != w.collect()[:200]


def test_sample_grid_seeded():
    grid = {"a": [1, 2], "b": [3, 4], "c": [5, 6]}
    first, second = sample_grid(grid, 5), sample_grid(grid, 5)
    assert first == second and len(first) == 5 and len({tuple(d.values()) for d in first}) == 5
    assert len(sample_grid({"a": [1, 2]}, 5)) == 2


def test_model_scores_every_cleaned_row(spark):
    from flowlens.plans import q_model, q_quality

    scored = q_model.q_score_batch_model(spark, SF_SMALL).collect()
    n = q_quality.flows_clean(spark, SF_SMALL).count()
    assert n > 0 and sorted(r["row"] for r in scored) == list(range(n))


def test_subset_eval_gives_all_six_metrics(spark):
    from flowlens.operators.select import subset_eval

    def flows(rows):
        return spark.createDataFrame([(x, 0.0, label, 1.0) for x, label in rows], "x double, y double, label_idx long, weight double")

    good = [(0.0, 0)] * 6 + [(1.0, 1)] * 6
    classes = spark.createDataFrame([(0, "a"), (1, "b")], "idx long, label string")
    test = flows([(0.0, 0)] * 6 + [(1.0, 1)] * 2 + [(1.0, 0)] * 2)
    params = {"n_estimators": 5, "max_depth": 2}
    row = subset_eval(spark, flows(good * 5), flows(good), test, ["x", "y"], classes, params, kind="rf", counts=[1]).filter("feature_count = 1").first()
    want = {"accuracy": 0.8, "precision_macro": 0.75, "recall_macro": 0.875, "f1_macro": (6 / 7 + 2 / 3) / 2, "f1_weighted": (8 * 6 / 7 + 2 * 2 / 3) / 10, "roc_auc_macro": 0.875}
    for metric, value in want.items():
        assert math.isclose(row[f"test_{metric}"], value, abs_tol=1e-9) and math.isclose(row[f"valid_{metric}"], 1.0, abs_tol=1e-9)


def test_search_draws_only_different_fits(spark):
    from flowlens.operators.train import rf_estimator
    from flowlens.plans.q_model import SEARCH_GRID

    applied = [(e.getNumTrees(), e.getMaxDepth(), e.getMinInstancesPerNode()) for e in map(rf_estimator, sample_grid(SEARCH_GRID, 100))]
    assert len(set(applied)) == len(applied)


def test_out_of_bag_votes_by_brute_force(spark):
    import random

    from flowlens.operators.train import assembler, in_bag_bits, rf_oob

    rnd = random.Random(4)
    rows = [(float(rnd.randrange(6)), float(rnd.randrange(4)), "k%d" % (i % 150), 1.0) for i in range(160)]
    rows = [(*r, int(r[0] + r[1] > 4) + int(r[0] > 4 and r[1] > 2) if rnd.random() < 0.8 else 0) for r in rows]
    data = spark.createDataFrame(rows, "x double, y double, row_key string, weight double, label_idx long").repartition(3)
    n = 34
    bags = data.select("row_key", in_bag_bits(F.col("row_key"), n).alias("bits"), *[(poisson_weight(F.col("row_key"), t) > 0).alias(f"b{t}") for t in range(n)])
    for r in bags.collect():
        assert [r["bits"][t // 32] >> t % 32 & 1 for t in range(n)] == [int(r[f"b{t}"]) for t in range(n)]
    for trees in (2, 12):  # two trees leave rows without a vote, twelve take two passes
        summary, models = rf_oob(data, ["x", "y"], {"n_estimators": trees, "max_depth": 3})
        assert len(models) == trees
        x = assembler(["x", "y"]).transform(data).select("*", *[(poisson_weight(F.col("row_key"), t) > 0).alias(f"b{t}") for t in range(trees)])
        right = voted = 0
        for r in x.collect():
            votes = [0.0] * 3
            for t, m in enumerate(models):
                if not r[f"b{t}"]:
                    for c, p in enumerate(m.predictProbability(r["features"]).toArray()):
                        votes[c] += float(p)
            if sum(votes):
                voted += 1
                votes = [round(v, 9) for v in votes]
                right += votes.index(max(votes)) == r["label_idx"]
        got = summary.first()
        assert (got["oob_rows"], got["rows_without_vote"], got["n_trees"]) == (voted, 160 - voted, trees)
        assert math.isclose(got["oob_accuracy"], right / voted, abs_tol=1e-12)
