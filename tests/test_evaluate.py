"""AUC ties, undefined AUC, zero division, exact quantiles vs numpy (FIXTURES D e_scores)."""

import numpy as np
from pyspark.sql import functions as F

from flowlens.operators import evaluate as E
from flowlens.operators.ordered import exact_quantiles


def _auc_bruteforce(y, s):
    pos = [b for a, b in zip(y, s) if a]
    neg = [b for a, b in zip(y, s) if not a]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_with_ties_and_undefined(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    score = np.round(rng.random(300), 1)  # many ties
    rows = [(int(t), [float(1 - v), float(v)]) for t, v in zip(y, score)] + [(1, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "label_idx long, probability array<double>")
    cls = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "label string, idx long")
    auc = {r["class_idx"]: r["roc_auc"] for r in E.auc_per_class(E.score_points(df, cls)).collect()}
    yy = list(y) + [1]
    ss = list(score) + [0.5]
    assert abs(auc[1] - _auc_bruteforce([t == 1 for t in yy], ss)) < 1e-12
    # monotone transform leaves AUC unchanged
    df2 = df.withColumn("probability", F.transform("probability", lambda v: v * v * 3 + 1))
    auc2 = {r["class_idx"]: r["roc_auc"] for r in E.auc_per_class(E.score_points(df2, cls)).collect()}
    assert abs(auc2[1] - auc[1]) < 1e-12


def test_zero_division_and_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "label_idx long, pred_idx long")
    cls = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "label string, idx long")
    pc = {r["class_idx"]: r for r in E.metrics_per_class(E.confusion(df, cls)).collect()}
    assert 3 not in pc  # absent from truth and prediction
    assert pc[1]["precision"] == 0.0 and pc[1]["recall"] == 0.0 and pc[1]["f1_score"] == 0.0
    ov = E.metrics_overall(E.metrics_per_class(E.confusion(df, cls))).first()
    assert abs(ov["accuracy"] - 0.75) < 1e-12


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.integers(0, 50, 500).astype(float), rng.random(300)])
    df = spark.createDataFrame([("g", float(v)) for v in vals] + [("h", 1.0)], "g string, v double")
    q = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.95], ["a", "b", "c"], buckets=16).collect()}
    for p, name in ((0.25, "a"), (0.5, "b"), (0.95, "c")):
        assert abs(q["g"][name] - float(np.percentile(vals, p * 100))) < 1e-9
    assert q["h"]["b"] == 1.0


def test_corr_pairwise_complete_with_nulls_and_constant(spark):
    import pandas as pd

    from flowlens.operators.stats import corr_matrix

    rng = np.random.default_rng(11)
    a = rng.random(60)
    b = a * 2 + rng.random(60) * 0.1
    b[[3, 7, 9]] = np.nan
    c = np.ones(60)
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    df = spark.createDataFrame([(float(x), None if np.isnan(y) else float(y), float(z)) for x, y, z in zip(a, b, c)], "a double, b double, c double")
    got = {(r[0], r[1]): r[2] for r in corr_matrix(df, None).collect()}
    assert abs(got[("a", "b")] - pdf["a"].corr(pdf["b"])) < 1e-12
    assert got[("a", "c")] is None and got[("c", "c")] is None and got[("a", "a")] == 1.0
    clean = spark.createDataFrame([(float(x), float(x) * 3 + 1, 2.0) for x in a], "a double, b double, c double")
    got2 = {(r[0], r[1]): r[2] for r in corr_matrix(clean, None).collect()}
    assert abs(got2[("a", "b")] - 1.0) < 1e-12 and got2[("b", "c")] is None
