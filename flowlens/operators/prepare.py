"""Encoding, exact stratified split, stratified sample, folds, class weights, split checks.

Row order in Spark is not defined, so "random" order is a salted md5 of the row's
content: deterministic, the same in any SQL engine, and uniform, so it also
provides skew-free range buckets (``ordered.hash_rank``).  Identical rows are
interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.exprs import c, is_inf, numeric_columns, row_hash
from flowlens.operators.ordered import hash_rank

# Fixed values of the reference: 70 / 15 / 15 split, seed 42, three folds.
TRAIN_PCT = 70
VALID_PCT = 15
SEED = 42
N_FOLDS = 3
STRAT_TOLERANCE = 0.01


def label_mapping(df: DataFrame, label_col: str = "Label") -> DataFrame:
    """Sorted distinct labels -> 0..K-1 (binary, case-sensitive order).  K rows."""
    labels = df.select(c(label_col).alias("label")).filter(F.col("label").isNotNull()).distinct()
    return labels.withColumn("idx", (F.row_number().over(Window.orderBy("label")) - 1).cast("bigint"))


def label_encode(df: DataFrame, label_col: str = "Label", mapping: DataFrame | None = None, out_col: str = "label_idx") -> DataFrame:
    """Add the class index (join with the K-row mapping; AQE broadcasts it)."""
    mapping = mapping if mapping is not None else label_mapping(df, label_col)
    m = mapping.select(F.col("label").alias("_lbl"), F.col("idx").alias(out_col))
    return df.join(m, c(label_col) == F.col("_lbl"), "left").drop("_lbl")


def split_xy(df: DataFrame, label_col: str = "Label") -> tuple[DataFrame, DataFrame]:
    """Features and target as two projections of the same rows."""
    return df.drop(label_col), df.select(label_col)


def with_row_hash(df: DataFrame, seed: int = SEED, name: str = "row_hash", cols: list[str] | None = None) -> DataFrame:
    return df.withColumn(name, row_hash(df, cols or df.columns, seed))


def stratified_split(
    df: DataFrame,
    label_col: str = "Label",
    seed: int = SEED,
    train_pct: int = TRAIN_PCT,
    valid_pct: int = VALID_PCT,
) -> DataFrame:
    """Exact per-class 70/15/15 split in salted-hash order; adds ``split``.

    Per class of n rows: the first ``n*70 div 100`` go to train, up to
    ``n*85 div 100`` to valid, the rest to test (a one-row class lands in test).
    """
    hashed = with_row_hash(df, seed, "_h")
    ranked = hash_rank(hashed, [label_col], "_h")
    cut1 = F.expr(f"_n * {train_pct} div 100")
    cut2 = F.expr(f"_n * {train_pct + valid_pct} div 100")
    r = F.col("_rank")
    split = F.when(r < cut1, F.lit("train")).when(r < cut2, F.lit("valid")).otherwise(F.lit("test"))
    return ranked.withColumn("split", split).drop("_h", "_rank", "_n")


def class_quotas(counts: DataFrame, n: int, label_col: str = "label", count_col: str = "n_c") -> DataFrame:
    """Largest-remainder quotas summing to ``min(n, N)`` on the K-row class table."""
    total = F.sum(count_col).over(Window.partitionBy())
    base = counts.withColumn("_N", total)
    target = F.least(F.lit(n).cast("bigint"), F.col("_N"))
    prod = F.col(count_col) * target
    base = base.withColumn("_floor", F.expr(f"({count_col} * least({n}, _N)) div _N")).withColumn("_rem", prod % F.col("_N"))
    left = target - F.sum("_floor").over(Window.partitionBy())
    order = Window.orderBy(F.col("_rem").desc(), F.col(label_col))
    return base.withColumn("quota", (F.col("_floor") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)).cast("bigint")).select(
        label_col, count_col, "quota"
    )


def stratified_sample(df: DataFrame, n: int, label_col: str = "Label", seed: int = SEED) -> DataFrame:
    """Exactly ``min(n, N)`` rows with class proportions kept (largest remainder), hash order."""
    hashed = with_row_hash(df, seed, "_h")
    counts = df.groupBy(c(label_col).alias("_lbl")).agg(F.count(F.lit(1)).alias("n_c"))
    quotas = class_quotas(counts, n, "_lbl", "n_c").select("_lbl", "quota")
    ranked = hash_rank(hashed, [label_col], "_h")
    return ranked.join(quotas, c(label_col).eqNullSafe(F.col("_lbl"))).filter(F.col("_rank") < F.col("quota")).drop(
        "_h", "_rank", "_n", "_lbl", "quota"
    )


def kfold_stratified(df: DataFrame, label_col: str = "Label", k: int = N_FOLDS, seed: int = SEED) -> DataFrame:
    """Fold id 0..k-1 dealt round-robin in hash order within each class (sizes differ by <= 1)."""
    hashed = with_row_hash(df, seed, "_h")
    ranked = hash_rank(hashed, [label_col], "_h")
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("bigint")).drop("_h", "_rank", "_n")


def class_weights(train: DataFrame, label_col: str = "label_idx") -> DataFrame:
    """Balanced weights N / (K * n_c) from the training rows (K-row result)."""
    counts = train.groupBy(c(label_col).alias(label_col)).agg(F.count(F.lit(1)).alias("n_c"))
    all_w = Window.partitionBy()
    return counts.select(
        label_col,
        (F.sum("n_c").over(all_w) / (F.count(F.lit(1)).over(all_w) * F.col("n_c"))).alias("weight"),
    )


def with_weights(df: DataFrame, weights: DataFrame, label_col: str = "label_idx", weight_col: str = "weight") -> DataFrame:
    return df.join(weights.withColumnRenamed("weight", weight_col), label_col, "left")


def split_distribution(df: DataFrame, label_col: str = "label_idx", split_col: str = "split") -> DataFrame:
    """Share of each class inside each split (long form, K x 3 rows)."""
    counts = df.groupBy(split_col, label_col).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.withColumn("proportion", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(split_col)))


def split_report(df: DataFrame, label_col: str = "label_idx", split_col: str = "split") -> DataFrame:
    """Per class: proportion in train / valid / test side by side (0.0 when absent)."""
    dist = split_distribution(df, label_col, split_col)
    piv = dist.groupBy(label_col).pivot(split_col, ["train", "valid", "test"]).agg(F.first("proportion"))
    return piv.select(
        label_col,
        *[F.coalesce(F.col(s), F.lit(0.0)).alias(f"{s}_proportion") for s in ["train", "valid", "test"]],
    )


def validate_splits(df: DataFrame, label_col: str = "label_idx", split_col: str = "split", num_classes: int | None = None, schemas: list | None = None) -> DataFrame:
    """Missing / infinite cells, class presence and max |proportion - train proportion| per split.

    ``schemas``: the splits' schemas where they were read from separate tables; ``identical_features`` compares them.
    """
    layouts = [[(f.name, f.dataType) for f in s.fields if f.name != split_col] for s in schemas or [df.schema]]
    same = all(layout == layouts[0] for layout in layouts)
    feats = [n for n in numeric_columns(df, exclude=(label_col,))]
    miss = sum((F.when(c(n).isNull() | F.isnan(c(n)), 1).otherwise(0) for n in feats), F.lit(0))
    infs = sum((F.when(is_inf(c(n)), 1).otherwise(0) for n in feats), F.lit(0))
    cells = df.agg(
        F.sum(miss + F.when(c(label_col).isNull(), 1).otherwise(0)).cast("bigint").alias("missing_cells"),
        F.sum(infs).cast("bigint").alias("infinite_cells"),
    )
    rep = split_report(df, label_col, split_col)
    k_expected = F.lit(num_classes) if num_classes is not None else F.count(F.lit(1))
    checks = rep.agg(
        F.max(F.abs(F.col("valid_proportion") - F.col("train_proportion"))).alias("max_diff_valid"),
        F.max(F.abs(F.col("test_proportion") - F.col("train_proportion"))).alias("max_diff_test"),
        (
            (F.count_if(F.col("train_proportion") > 0) == k_expected)
            & (F.count_if(F.col("valid_proportion") > 0) == k_expected)
            & (F.count_if(F.col("test_proportion") > 0) == k_expected)
        ).alias("all_classes_present"),
    )
    # two one-row aggregates side by side without a join: union, then max per struct
    a = checks.select(F.struct(*checks.columns).alias("checks"))
    b = cells.select(F.struct(*cells.columns).alias("cells"))
    row = a.unionByName(b, allowMissingColumns=True).agg(F.max("checks").alias("checks"), F.max("cells").alias("cells"))
    return row.select(
        F.lit(same).alias("identical_features"),
        (F.col("cells.missing_cells") == 0).alias("no_missing"),
        (F.col("cells.infinite_cells") == 0).alias("no_infinite"),
        F.col("checks.all_classes_present").alias("all_classes_present"),
        F.col("checks.max_diff_valid").alias("max_diff_valid"),
        F.col("checks.max_diff_test").alias("max_diff_test"),
        ((F.col("checks.max_diff_valid") < STRAT_TOLERANCE) & (F.col("checks.max_diff_test") < STRAT_TOLERANCE)).alias(
            "stratification_preserved"
        ),
    )
