"""CSV edge files, subset choice, timing statistics, oracle smoke (FIXTURES D e_header, e_subsets, e_runs)."""

import os
import tempfile

import numpy as np
import pytest

from flowlens.operators import select as S
from flowlens.sources import csv as CSV

from conftest import SF_SMALL


def _write(folder: str, name: str, data: bytes) -> str:
    path = os.path.join(folder, name)
    with open(path, "wb") as fh:
        fh.write(data)
    return path


def test_csv_header_types_and_widths(spark):
    d = tempfile.mkdtemp(prefix="flowlens-csv-")
    text = (
        " Flow  Bytes/s,Fwd Header Length,Fwd Header Length, Label\n"
        "1.5,2,3,BENIGN\n\n"
        "7,8\n"
        "Infinity,NaN,inf, DoS  hulk\n"
    ).encode()
    p = _write(d, "b.csv", text)
    df, report = CSV.src_csv(spark, p)
    assert df.columns == ["Flow Bytes/s", "Fwd Header Length", "Fwd Header Length.1", "Label"]
    rows = df.collect()
    assert len(rows) == 3  # blank line skipped, short row padded
    assert rows[2]["Flow Bytes/s"] == float("inf") and rows[2]["Fwd Header Length"] is None
    assert dict(df.dtypes)["Fwd Header Length.1"] == "double"
    wide = _write(d, "c.csv", b"a,Label\n1,BENIGN\n2,Bot,EXTRA\n")
    with pytest.raises(ValueError):
        CSV.src_csv(spark, wide, strict=True)
    kept, rep = CSV.src_csv(spark, wide, strict=False)
    assert kept.count() == 1 and rep.first()["dropped_wide_rows"] == 1


def test_latin1_fallback_and_required_label(spark):
    d = tempfile.mkdtemp(prefix="flowlens-csv-")
    p = _write(d, "l.csv", "x,Label\n1,Web Attack \x96 Brute Force\n".encode("latin-1"))
    df, rep = CSV.src_csv(spark, p)
    assert rep.first()["encoding"] == "ISO-8859-1"
    from flowlens.operators.quality import std_labels

    assert std_labels(df).first()["Label"] == "Web Attack"
    q = _write(d, "nolabel.csv", b"x,y\n1,2\n")
    with pytest.raises(ValueError):
        CSV.src_csv(spark, q)
    with pytest.raises(FileNotFoundError):
        CSV.src_discover(spark, d + "/absent")


def _results(spark, f1s):
    rows = [(k, 0.9, f, 0.0, 0.0, f) for k, f in f1s]
    return spark.createDataFrame(rows, "feature_count long, test_accuracy double, test_f1_macro double, training_time_seconds double, test_inference_time_seconds double, valid_f1_macro double")


def test_pick_subset_and_fallback(spark):
    ok = _results(spark, [(70, 0.90), (50, 0.895), (20, 0.892), (10, 0.80), (5, 0.70), (60, 0.91), (30, 0.85)])
    assert S.pick_subset(ok).first()["optimal_feature_count"] == 20
    none = _results(spark, [(70, 0.90), (50, 0.80), (10, 0.1)])
    assert S.pick_subset(none).first()["optimal_feature_count"] == 70
    t = {r["feature_count"]: r for r in S.tradeoffs(ok).collect()}
    assert abs(t[20]["feature_reduction_percentage"] - (1 - 20 / 70) * 100) < 1e-9
    assert t[60]["macro_f1_loss_percentage"] == 0.0


def test_timing_stats_match_numpy(spark):
    lat = [0.11, 0.12, 0.10, 0.13, 0.20, 0.11, 0.12, 0.15, 0.10, 0.12]
    runs = spark.createDataFrame([(7, i, v) for i, v in enumerate(lat)], "feature_count long, run long, seconds double")
    r = S.timing_stats(runs, "feature_count", "seconds", n_rows=1000).first()
    a = np.array(lat)
    assert abs(r["mean_seconds"] - a.mean()) < 1e-12
    assert abs(r["median_seconds"] - np.median(a)) < 1e-12
    assert abs(r["std_seconds"] - a.std()) < 1e-12
    assert abs(r["p95_seconds"] - np.percentile(a, 95)) < 1e-12
    assert abs(r["throughput_samples_per_second"] - 1000 / a.mean()) < 1e-6
    assert sorted(S.subset_plan(spark, 64).toPandas()["feature_count"].tolist(), reverse=True)[0] == 64


SMOKE = ["class_distribution_clean", "profile_features", "describe_numeric", "stratified_split", "auc_per_class", "shap_global", "score_batch", "pick_subset"]


@pytest.mark.parametrize("name", SMOKE)
def test_oracle_smoke(spark, name):
    from oracle_check import compare, duck
    import __spark_entry__ as E

    res = compare(spark, duck(SF_SMALL), name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert res["status"] == "ok", res


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0 and "percentage" in df.columns
