"""Edge tables for labels, missing / infinite values, duplicates and profiles (FIXTURES D)."""

import math

from pyspark.sql import functions as F

from flowlens.operators import quality as Q


def test_label_normalisation(spark):
    rows = [(" benign ",), ("Web Attack – XSS",), ("Web Attack � Brute Force",), ("DOS  hulk",), (None,), ("Unknown  Thing ",), ("BotNet",), ("\tportscan\n",)]
    df = spark.createDataFrame(rows, "Label string")
    got = [r[0] for r in Q.std_labels(df).collect()]
    assert got == ["BENIGN", "Web Attack", "Web Attack", "DoS Hulk", None, "Unknown Thing", "Bot", "PortScan"]
    assert Q.std_labels(df, missing_label="nan").collect()[4][0] == "nan"


def test_missing_infinite_and_dedup(spark):
    inf = float("inf")
    rows = [("a", float("nan")), ("a", None), ("a", inf), ("a", -inf), ("a", -0.0), ("a", 0.0)]
    df = Q.nan_to_null(spark.createDataFrame(rows, "Label string, x double"))
    prof = {r["feature_name"]: r for r in Q.profile_features(df).collect()}
    assert prof["x"]["missing_count"] == 2 and prof["x"]["infinite_count"] == 2
    # NULL, +inf, -inf, 0.0 (-0.0 equals 0.0): four distinct values, missing counted once
    assert prof["x"]["unique_count"] == 4
    replaced, count = Q.replace_inf(df)
    assert count.first()[0] == 2
    deduped, stats = Q.dedup_rows(replaced)
    assert deduped.count() == 2  # NULL row and 0.0 row
    assert stats.first()["duplicates_removed"] == 4


def test_constant_near_constant_empty(spark):
    rows = [(1.0, 1.0 if i < 199 else 2.0, None) for i in range(200)]
    df = spark.createDataFrame(rows, "c double, near double, empty double")
    prof = {r["feature_name"]: r for r in Q.profile_features(df, "Label").collect()}
    assert prof["c"]["is_constant"] and not prof["c"]["is_near_constant"]
    assert prof["near"]["is_near_constant"] and not prof["near"]["is_constant"]
    assert prof["empty"]["is_empty"] and prof["empty"]["unique_count"] == 1


def test_rare_classes_keep_null_and_count_zero(spark):
    df = spark.createDataFrame([("Heartbleed",), (None,), ("BENIGN",)], "Label string")
    kept, removed = Q.drop_rare_classes(df)
    assert kept.count() == 2
    assert {r["class_label"]: r["removed_count"] for r in removed.collect()} == {"Heartbleed": 1, "Infiltration": 0}


def test_clean_is_idempotent(spark):
    rows = [("BENIGN", 1.0), ("BENIGN", 1.0), ("Bot", float("inf")), ("Bot", 2.0)]
    df = Q.nan_to_null(spark.createDataFrame(rows, "Label string, x double"))
    once = Q.clean(df, constant=[])
    twice = Q.clean(once, constant=[])
    assert sorted(once.collect()) == sorted(twice.collect())
    assert once.count() == 2


def test_audit_order_counts(spark):
    rows = [("Heartbleed", 1.0), ("BENIGN", float("inf")), ("BENIGN", None), ("BENIGN", 3.0), ("BENIGN", 3.0)]
    audit = {r["step"]: r["value"] for r in Q.clean_audit(spark.createDataFrame(rows, "Label string, x double"), constant=[]).collect()}
    assert audit["original_samples"] == 5
    assert audit["removed_heartbleed"] == 1
    assert audit["replaced_infinities"] == 1
    # inf became NULL before dedup, so it equals the NULL row: 2 duplicates removed
    assert audit["removed_duplicates"] == 2
    assert audit["removed_missing"] == 1
    assert audit["final_samples"] == 1
    assert not math.isnan(float(audit["final_samples"]))
