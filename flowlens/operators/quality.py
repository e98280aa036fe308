"""Label normalisation, cleaning steps with counted audit, profiles, class distributions.

All counts are lazy aggregates; the cleaning audit is computed from one pass over
the input plus one grouping shuffle (see :func:`clean_audit`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.exprs import (
    FLOAT_TYPES,
    as_missing,
    c,
    is_inf,
    numeric_columns,
    pct_guard,
)

# Fixed values that must equal the reference: case-insensitive spellings of the
# flow classes and the canonical class name each maps to.
LABEL_CANON = {
    "benign": "BENIGN",
    "bot": "Bot",
    "botnet": "Bot",
    "ddos": "DDoS",
    "dos goldeneye": "DoS GoldenEye",
    "dos hulk": "DoS Hulk",
    "dos slowhttptest": "DoS Slowhttptest",
    "dos slowloris": "DoS slowloris",
    "ftp-patator": "FTP-Patator",
    "ssh-patator": "SSH-Patator",
    "portscan": "PortScan",
    "infiltration": "Infiltration",
    "heartbleed": "Heartbleed",
}
# Every label containing this text becomes the merged class name.
WEB_ATTACK_TOKEN = "web attack"
WEB_ATTACK_CLASS = "Web Attack"
# Classes removed as too rare, and the constant features dropped.
RARE_CLASSES = ["Heartbleed", "Infiltration"]
CONSTANT_FEATURES = [
    "Bwd PSH Flags",
    "Bwd URG Flags",
    "Fwd Avg Bytes/Bulk",
    "Fwd Avg Packets/Bulk",
    "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk",
    "Bwd Avg Packets/Bulk",
    "Bwd Avg Bulk Rate",
]
# Fixed thresholds of the profiles.
NEAR_CONSTANT_SHARE = 0.99
HIGH_CARDINALITY = 10
SEVERE_IMBALANCE_PCT = 0.5


def collapse_ws(x: Column) -> Column:
    """Trim and collapse runs of whitespace to one space.

    One regexp: after every run became a single space, only spaces can remain
    at the ends, which ``trim`` removes.
    """
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_label(x: Column, missing_label: str | None = None) -> Column:
    """Canonical class name for one raw label value (rule of ``std_labels``)."""
    clean = collapse_ws(x)
    low = F.lower(clean)
    canon = F.create_map(*[F.lit(v) for kv in LABEL_CANON.items() for v in kv])
    return (
        F.when(x.isNull(), F.lit(missing_label).cast("string"))
        .when(low.contains(WEB_ATTACK_TOKEN), F.lit(WEB_ATTACK_CLASS))
        .otherwise(F.coalesce(F.try_element_at(canon, low), clean))
    )


def std_columns(df: DataFrame) -> DataFrame:
    """Trim and collapse whitespace in column names."""
    return df.toDF(*[" ".join(name.split()) for name in df.columns])


def std_labels(df: DataFrame, label_col: str = "Label", missing_label: str | None = None) -> DataFrame:
    """Normalise the label column in place (no UDF: regexp + map lookup)."""
    return df.withColumn(label_col, normalize_label(c(label_col), missing_label))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Rule S1: NaN is missing.  Applied on ingest to every float column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOAT_TYPES)}
    return df.select(*[as_missing(c(n)).alias(n) if n in floats else c(n) for n in df.columns])


def drop_rare_classes(
    df: DataFrame, classes: list[str] = RARE_CLASSES, label_col: str = "Label"
) -> tuple[DataFrame, DataFrame]:
    """Remove rows whose label is listed; count removed rows per listed class (zeros kept).

    A NULL label is kept, as a missing label is not a listed class.
    """
    listed = c(label_col).isin(*classes)
    kept = df.filter(~F.coalesce(listed, F.lit(False)))
    counts = df.agg(*[F.count_if(c(label_col) == F.lit(k)).alias(f"n{i}") for i, k in enumerate(classes)])
    stack = ", ".join(f"'{k.replace(chr(39), chr(39) * 2)}', n{i}" for i, k in enumerate(classes))
    removed = counts.selectExpr(f"stack({len(classes)}, {stack}) AS (class_label, removed_count)")
    return kept, removed


def replace_inf(df: DataFrame, cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """+/-Infinity -> missing in numeric columns; also returns the number replaced."""
    cols = [n for n in (cols or numeric_columns(df)) if n in set(numeric_columns(df))]
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOAT_TYPES)}
    cols = [n for n in cols if n in floats]
    out = df.select(*[F.when(~is_inf(c(n)) | c(n).isNull(), c(n)).alias(n) if n in cols else c(n) for n in df.columns])
    count = df.agg(inf_cells_sum(cols).alias("replaced_infinities"))
    return out, count


def inf_cells_sum(cols: list[str]) -> Column:
    if not cols:
        return F.lit(0).cast("bigint")
    return reduce(lambda a, b: a + b, [F.count_if(is_inf(c(n))) for n in cols]).cast("bigint")


def any_missing(cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c(n).isNull() for n in cols])


def dedup_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole-row dedup (NULL equals NULL).  Stats: before / after / removed."""
    deduped = df.dropDuplicates()
    stats = (
        df.groupBy(*[c(n) for n in df.columns])
        .agg(F.count(F.lit(1)).alias("cnt"))
        .agg(
            F.sum("cnt").cast("bigint").alias("rows_before"),
            F.count(F.lit(1)).cast("bigint").alias("rows_after"),
        )
        .withColumn("duplicates_removed", F.col("rows_before") - F.col("rows_after"))
    )
    return deduped, stats


def count_duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row (null-safe, whole row)."""
    return (
        df.groupBy(*[c(n) for n in df.columns])
        .agg(F.count(F.lit(1)).alias("cnt"))
        .agg(F.sum(F.col("cnt") - 1).cast("bigint").alias("duplicate_count"))
        .fillna(0)
    )


def drop_missing(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop rows with any missing cell (label included); count them."""
    out = df.dropna(how="any")
    stats = df.agg(F.count_if(any_missing(df.columns)).cast("bigint").alias("missing_rows_removed"))
    return out, stats


def drop_columns(df: DataFrame, names: list[str] = CONSTANT_FEATURES) -> tuple[DataFrame, list[str]]:
    """Drop the named columns that exist; return the list actually dropped."""
    present = [n for n in names if n in df.columns]
    return df.drop(*present), present


def clean(
    df: DataFrame,
    label_col: str = "Label",
    rare: list[str] = RARE_CLASSES,
    constant: list[str] = CONSTANT_FEATURES,
) -> DataFrame:
    """The cleaning chain in the reference order: rare -> inf -> dedup -> missing -> columns.

    Feed it a written ingest table (see ``plans.q_quality.flows_in``): over a raw
    projection, filter pushdown would re-evaluate the label and NaN/Inf
    expressions inside the pushed filters.
    """
    df, _ = drop_rare_classes(df, rare, label_col)
    df, _ = replace_inf(df)
    df = df.dropDuplicates()
    df = df.dropna(how="any")
    df, _ = drop_columns(df, constant)
    return df


def clean_audit(
    df: DataFrame,
    label_col: str = "Label",
    rare: list[str] = RARE_CLASSES,
    constant: list[str] = CONSTANT_FEATURES,
) -> DataFrame:
    """Ordered audit trail ``(step_order, step, value)`` of the five cleaning steps.

    One aggregate over the input gives the original size, per-class removals and
    the infinities among kept rows; one grouping of the kept rows by all columns
    gives duplicates and missing rows.  Dropped columns are known from the schema.
    """
    listed = F.coalesce(c(label_col).isin(*rare), F.lit(False))
    numeric = [n for n in numeric_columns(df) if n in {f.name for f in df.schema.fields if isinstance(f.dataType, FLOAT_TYPES)}]
    first = df.agg(
        F.count(F.lit(1)).cast("bigint").alias("original_samples"),
        *[F.count_if(c(label_col) == F.lit(k)).cast("bigint").alias(f"removed_{k.lower()}") for k in rare],
        (reduce(lambda a, b: a + b, [F.count_if(~listed & is_inf(c(n))) for n in numeric]) if numeric else F.lit(0))
        .cast("bigint")
        .alias("replaced_infinities"),
    )
    kept, _ = drop_rare_classes(df, rare, label_col)
    kept, _ = replace_inf(kept)
    grouped = kept.groupBy(*[c(n) for n in kept.columns]).agg(F.count(F.lit(1)).alias("cnt"))
    missing_flag = any_missing(kept.columns)
    second = grouped.agg(
        (F.sum("cnt") - F.count(F.lit(1))).cast("bigint").alias("removed_duplicates"),
        F.count_if(missing_flag).cast("bigint").alias("removed_missing"),
        F.count_if(~missing_flag).cast("bigint").alias("final_samples"),
    )
    dropped = [n for n in constant if n in df.columns]
    names1 = ["original_samples"] + [f"removed_{k.lower()}" for k in rare] + ["replaced_infinities"]
    rows1 = first.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("step_order"), F.lit(n).alias("step"), F.col(n).alias("value")) for i, n in enumerate(names1)])).alias("s")
    ).select("s.*")
    base = len(names1)
    names2 = ["removed_duplicates", "removed_missing"]
    rows2 = second.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(base + i).alias("step_order"), F.lit(n).alias("step"), F.col(n).alias("value")) for i, n in enumerate(names2)],
                F.struct(F.lit(base + 2).alias("step_order"), F.lit("dropped_features").alias("step"), F.lit(len(dropped)).cast("bigint").alias("value")),
                F.struct(F.lit(base + 3).alias("step_order"), F.lit("final_samples").alias("step"), F.col("final_samples").alias("value")),
            )
        ).alias("s")
    ).select("s.*")
    return rows1.unionByName(rows2).withColumn("step_order", F.col("step_order").cast("bigint"))


def validate_clean(df: DataFrame, label_col: str = "Label") -> DataFrame:
    """Post-clean checks: shape, classes, remaining duplicates / missing / infinite cells."""
    numeric = numeric_columns(df)
    floats = [n for n in numeric if n in {f.name for f in df.schema.fields if isinstance(f.dataType, FLOAT_TYPES)}]
    grouped = df.groupBy(*[c(n) for n in df.columns]).agg(F.count(F.lit(1)).alias("cnt"))
    missing_cells = reduce(lambda a, b: a + b, [F.when(c(n).isNull() | (F.isnan(c(n)) if n in floats else F.lit(False)), 1).otherwise(0) for n in df.columns])
    inf_cells = reduce(lambda a, b: a + b, [F.when(is_inf(c(n)), 1).otherwise(0) for n in floats]) if floats else F.lit(0)
    return grouped.agg(
        F.sum("cnt").cast("bigint").alias("num_samples"),
        F.lit(len(df.columns)).cast("bigint").alias("num_features"),
        F.count_distinct(c(label_col)).cast("bigint").alias("num_classes"),
        F.array_join(F.array_sort(F.collect_set(c(label_col))), ",").alias("classes"),
        (F.sum("cnt") - F.count(F.lit(1))).cast("bigint").alias("remaining_duplicates"),
        F.coalesce(F.sum(missing_cells * F.col("cnt")), F.lit(0)).cast("bigint").alias("remaining_missing"),
        F.coalesce(F.sum(inf_cells * F.col("cnt")), F.lit(0)).cast("bigint").alias("remaining_infinite"),
    )


def _long_values(df: DataFrame, cols: list[str], dtype: str) -> DataFrame:
    """``(feature_name, value)`` rows for the given columns (NULLs kept)."""
    return df.select(*[c(n).cast(dtype).alias(n) for n in cols]).unpivot([], [c(n) for n in cols], "feature_name", "value")


def profile_features(df: DataFrame, label_col: str = "Label") -> DataFrame:
    """Per-column quality profile from one unpivot and a two-level aggregate.

    Level 1 counts each distinct (feature, value); level 2 derives unique count
    (missing counts as one value), mode share, missing and infinite counts.  Both
    levels aggregate partially before the shuffle, so a hot value never lands in
    one task as raw rows.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = numeric_columns(df)
    others = [n for n in df.columns if n not in numeric]
    parts = []
    if numeric:
        parts.append(_long_values(df, numeric, "double").withColumn("value", as_missing(F.col("value"))).withColumn("svalue", F.lit(None).cast("string")))
    if others:
        parts.append(_long_values(df, others, "string").withColumnRenamed("value", "svalue").withColumn("value", F.lit(None).cast("double")))
    longv = reduce(lambda a, b: a.unionByName(b), parts)
    level1 = longv.groupBy("feature_name", "value", "svalue").agg(F.count(F.lit(1)).alias("cnt"))
    missing_value = F.col("value").isNull() & F.col("svalue").isNull()
    level2 = level1.groupBy("feature_name").agg(
        F.sum(F.when(missing_value, F.col("cnt")).otherwise(0)).cast("bigint").alias("missing_count"),
        F.sum(F.when(is_inf(F.col("value")), F.col("cnt")).otherwise(0)).cast("bigint").alias("infinite_count"),
        F.count(F.lit(1)).cast("bigint").alias("unique_count"),
        F.max("cnt").cast("bigint").alias("mode_count"),
        F.sum("cnt").cast("bigint").alias("num_samples"),
    )
    dtype_rows = df.sparkSession.createDataFrame(
        [(n, _pandas_dtype(types[n])) for n in df.columns], "feature_name string, dtype string"
    )
    prof = dtype_rows.join(level2, "feature_name", "left")
    n = F.col("num_samples")
    is_object = (F.col("dtype") == "object") & (F.col("feature_name") != F.lit(label_col))
    return prof.select(
        "feature_name",
        "dtype",
        "missing_count",
        pct_guard(F.col("missing_count"), n).alias("missing_pct"),
        "infinite_count",
        pct_guard(F.col("infinite_count"), n).alias("infinite_pct"),
        "unique_count",
        (F.col("unique_count") == 1).alias("is_constant"),
        ((F.col("unique_count") != 1) & (n > 0) & (F.col("mode_count") / n >= F.lit(NEAR_CONSTANT_SHARE))).alias("is_near_constant"),
        (F.col("missing_count") == n).alias("is_empty"),
        is_object.alias("is_object_type"),
        (is_object & (F.col("unique_count") > HIGH_CARDINALITY)).alias("is_high_cardinality"),
    )


def _pandas_dtype(t: T.DataType) -> str:
    """dtype names as the reference reports them."""
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float64"
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "int64"
    if isinstance(t, T.BooleanType):
        return "bool"
    return "object"


def _with_share(counts: DataFrame, count_col: str = "sample_count") -> DataFrame:
    """Add ``percentage`` using the total over a K-row class table (bounded by the class count)."""
    total = F.sum(count_col).over(Window.partitionBy())
    return counts.withColumn("percentage", pct_guard(F.col(count_col), total))


def profile_labels(df: DataFrame, label_col: str = "Label", missing_label: str = "nan") -> DataFrame:
    """Count and share per class (missing kept as its own class) and a severe-imbalance flag."""
    counts = df.groupBy(F.coalesce(c(label_col), F.lit(missing_label)).alias("class_label")).agg(
        F.count(F.lit(1)).cast("bigint").alias("sample_count")
    )
    return _with_share(counts).withColumn("is_severely_imbalanced", F.col("percentage") < F.lit(SEVERE_IMBALANCE_PCT))


def class_distribution_clean(df: DataFrame, label_col: str = "Label", missing_label: str = "nan") -> DataFrame:
    """Count and share per class after cleaning."""
    counts = df.groupBy(F.coalesce(c(label_col), F.lit(missing_label)).alias("class_label")).agg(
        F.count(F.lit(1)).cast("bigint").alias("sample_count")
    )
    return _with_share(counts)


def class_distribution(df: DataFrame, label_col: str = "Label") -> DataFrame:
    """Count, share and Majority/Minority role (largest class; ties broken by label)."""
    counts = df.filter(c(label_col).isNotNull()).groupBy(c(label_col).alias("class_label")).agg(
        F.count(F.lit(1)).cast("bigint").alias("sample_count")
    )
    order = Window.partitionBy().orderBy(F.col("sample_count").desc(), F.col("class_label"))
    return _with_share(counts).withColumn(
        "role", F.when(F.row_number().over(order) == 1, F.lit("Majority")).otherwise(F.lit("Minority"))
    )


def dataset_summary(df: DataFrame, label_col: str = "Label", num_files: int = 1) -> DataFrame:
    """Rows, columns (label included), labels, duplicates, missing and infinite cells in one row."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOAT_TYPES)]
    missing_cell = lambda n: c(n).isNull() | (F.isnan(c(n)) if n in floats else F.lit(False))
    grouped = df.groupBy(*[c(n) for n in df.columns]).agg(F.count(F.lit(1)).alias("cnt"))
    miss = reduce(lambda a, b: a + b, [F.when(missing_cell(n), 1).otherwise(0) for n in df.columns])
    infs = reduce(lambda a, b: a + b, [F.when(is_inf(c(n)), 1).otherwise(0) for n in floats]) if floats else F.lit(0)
    return grouped.agg(
        F.lit(num_files).cast("bigint").alias("num_files"),
        F.sum("cnt").cast("bigint").alias("total_samples"),
        F.lit(len(df.columns)).cast("bigint").alias("num_features"),
        F.lit(",".join(sorted(df.columns))).alias("feature_names"),
        F.array_join(F.array_sort(F.collect_set(c(label_col))), ",").alias("unique_labels"),
        F.count_distinct(c(label_col)).cast("bigint").alias("num_labels"),
        (F.sum("cnt") - F.count(F.lit(1))).cast("bigint").alias("duplicate_count"),
        F.coalesce(F.sum(miss * F.col("cnt")), F.lit(0)).cast("bigint").alias("missing_count"),
        F.coalesce(F.sum(infs * F.col("cnt")), F.lit(0)).cast("bigint").alias("inf_count"),
    )


def basic_metrics(df: DataFrame) -> DataFrame:
    """Shape and dtypes; memory is the optimizer's size estimate (informational only)."""
    size = str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    dtypes = ",".join(f"{n}:{t}" for n, t in df.dtypes)
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("num_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("num_columns"),
        F.lit(dtypes).alias("dtypes"),
        F.lit(size).cast("decimal(38,0)").alias("estimated_bytes"),
    )


def eda_overview(df: DataFrame, label_col: str = "Label") -> DataFrame:
    """Samples, predictors, classes and the dtype histogram of the predictors."""
    predictors = [n for n in df.columns if n != label_col]
    hist: dict[str, int] = {}
    for f in df.schema.fields:
        if f.name != label_col:
            hist[_pandas_dtype(f.dataType)] = hist.get(_pandas_dtype(f.dataType), 0) + 1
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("num_samples"),
        F.lit(len(predictors)).cast("bigint").alias("num_predictors"),
        F.count_distinct(c(label_col)).cast("bigint").alias("num_classes"),
        F.lit(",".join(f"{k}:{v}" for k, v in sorted(hist.items()))).alias("dtype_counts"),
    )
