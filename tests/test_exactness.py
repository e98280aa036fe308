"""Cases where precision, order or width used to matter: exact hashes, wide counts, narrow columns, odd CSV rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions.exprs import row_hash
from flowlens.operators import evaluate as E
from flowlens.operators import prepare as P
from flowlens.operators import score as SC
from flowlens.operators.stats import corr_matrix
from flowlens.sources import csv as CSV


def test_close_and_odd_values_hash_apart(spark):
    values = [1e-7, 2e-7, 1e33, 2e33, 5e-324, float("inf"), float("-inf"), float("nan"), None, 0.0, 1.0, 1.0 + 2**-52]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert df.select(row_hash(df)).distinct().count() == len(values)
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert zeros.select(row_hash(zeros)).distinct().count() == 1
    texts = spark.createDataFrame([("a|1:b", "c"), ("a", "b|1:c"), (None, "~"), ("~", None)], "x string, y string")
    assert texts.select(row_hash(texts)).distinct().count() == 4


def test_split_does_not_depend_on_partitioning(spark):
    rows = [("a" if i % 3 else "b", 1.0 + i * 1e-8, 1e33 + i * 1e20) for i in range(200)]
    df = spark.createDataFrame(rows, "Label string, x double, y double")
    splits = [{(r["x"], r["y"]): r["split"] for r in P.stratified_split(df.repartition(n)).collect()} for n in (1, 7)]
    assert splits[0] == splits[1] and len(splits[0]) == 200


def test_auc_of_very_large_counts(spark):
    points = spark.createDataFrame([(0, 0.1, 0, 4 * 10**9), (0, 0.9, 4 * 10**9, 0)], "class_idx long, score double, pos long, neg long")
    assert E.auc_per_class(points).first()["roc_auc"] == 1.0


def test_correlation_of_large_narrow_columns(spark):
    rng = np.random.default_rng(2)
    a = 1.7e9 + 100 * rng.normal(size=2000)
    b = a + 30 * rng.normal(size=2000)
    want = np.corrcoef(a, b)[0, 1]
    for hole in (None, float("nan"), float("inf")):
        rows = [(float(x), float(y), hole if i == 5 else float(i), 3.0) for i, (x, y) in enumerate(zip(a, b))]
        got = {(r[0], r[1]): r[2] for r in corr_matrix(spark.createDataFrame(rows, "a double, b double, c double, k double"), None).collect()}
        assert abs(got[("a", "b")] - want) < 1e-9 and got[("a", "a")] == 1.0
        assert got[("a", "k")] is None and got[("k", "k")] is None and got[("c", "a")] is not None


def test_blank_search_returns_all(spark):
    preds = spark.createDataFrame([(0, "BENIGN", 1.0), (1, "DDoS", 0.5)], "row long, prediction string, confidence double")
    assert SC.search_predictions(preds, "  ").count() == 2 and SC.search_predictions(preds, " ddos ").count() == 1


def test_csv_rows_of_other_widths(spark, tmp_path):
    path = str(tmp_path / "w.csv")
    with open(path, "w") as f:
        f.write('a,b,Label\n1,2,BENIGN\n7,8,,EX\n3,"x, y",Bot\n\n4,5\n6,7,"q""uo,te"\n')
    kept, report = CSV.src_csv(spark, path, strict=False)
    assert report.first()["dropped_wide_rows"] == 1 and kept.count() == len(kept.collect()) == 4
    assert sorted(r["Label"] or "" for r in kept.collect()) == ["", "BENIGN", "Bot", 'q"uo,te']
    with pytest.raises(ValueError):
        CSV.src_csv(spark, path, strict=True)
    same = CSV.src_csv_width_filter(spark, path)
    assert same.count() == len(same.collect()) == same.select("a").count() == 3
    assert dict(same.dtypes) == {"a": "double", "b": "string", "Label": "string"}


def test_types_hold_for_the_whole_load_and_positions(spark, tmp_path):
    for k, body in enumerate(["a,Label\n1,x\n2,y\n", "a,Label\nbad,x\n", "a,b,Label\n5,1,z\n"]):
        (tmp_path / f"{k}.csv").write_text(body)
    os.mkdir(tmp_path / "below")
    (tmp_path / "below" / "9.csv").write_text("a,Label\n9,x\n")
    df = CSV.read_flow_files(spark, str(tmp_path), positions=True)
    assert dict(df.dtypes)["a"] == "string" and dict(df.dtypes)["b"] == "double"
    got = sorted((r["source_file"].rsplit("/", 1)[-1], r["file_row"], r["a"]) for r in df.collect())
    assert got == [("0.csv", 0, "1"), ("0.csv", 1, "2"), ("1.csv", 0, "bad"), ("2.csv", 0, "5")]


def test_splits_of_different_schemas_are_told(spark):
    df = spark.createDataFrame([(0, 1.0, s) for s in ("train", "valid", "test")], "label_idx long, x double, split string")
    other = df.withColumn("x", F.col("x").cast("string")).schema
    assert P.validate_splits(df, schemas=[df.schema, df.schema]).first()["identical_features"]
    assert not P.validate_splits(df, schemas=[df.schema, other]).first()["identical_features"]


def test_quantiles_of_large_groups_are_exact(spark, monkeypatch):
    from flowlens.operators import ordered

    monkeypatch.setattr(ordered, "SMALL_GROUP", 50)
    rng = np.random.default_rng(7)
    groups = {"normal": rng.normal(size=60_000), "ties": np.round(rng.exponential(size=50_000), 1), "one": np.full(30_000, 2.5), "two": np.array([1.0, 4.0])}
    groups["half"] = np.where(rng.random(40_000) < 0.34, 7.0, rng.normal(size=40_000))
    rows = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g string, v double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r["g"]: r for r in ordered.exact_quantiles(rows, ["g"], "v", probs, [f"q{i}" for i in range(7)]).collect()}
    for g, xs in groups.items():
        assert np.allclose([got[g][f"q{i}"] for i in range(7)], np.quantile(xs, probs), rtol=1e-12, atol=0), g
