"""Model training with Spark ML: weighted random forest, one-vs-rest boosted trees, seeded search.

Spark ML trains on the executors (aggregated split statistics per node); only
the fitted model (bounded by trees x nodes) is on the driver.
"""

from __future__ import annotations

import math
import random
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.exprs import c
from flowlens.operators import evaluate as E
from flowlens.operators import grow as G

SEED = 42
# Spark's largest tree depth stands in for "unlimited".
MAX_DEPTH_UNLIMITED = 30
# Fixed values of the reference: search grids, iterations, folds, tuning rows.
RF_GRID = {
    "n_estimators": [200, 300],
    "max_depth": [20, None],
    "min_samples_split": [2, 5],
    "min_samples_leaf": [1, 2],
    "max_features": ["sqrt"],
}
GBT_DEFAULTS = {"n_estimators": 400, "max_depth": 8, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.9}
SEARCH_ITERATIONS = 5
SEARCH_FOLDS = 3
TUNING_SIZE = 250_000
# Rows a training task holds at most: every level of the trees reads a task's cached rows again, whatever the table's size.
FIT_ROWS = 250_000


def assembler(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep")


def rf_estimator(params: dict, label_col: str = "label_idx", weight_col: str | None = "weight") -> RandomForestClassifier:
    """Map reference parameter names onto Spark's forest (min_samples_split has no twin)."""
    depth = params.get("max_depth")
    est = RandomForestClassifier(
        labelCol=label_col,
        featuresCol="features",
        numTrees=int(params.get("n_estimators", 100)),
        maxDepth=MAX_DEPTH_UNLIMITED if depth is None else int(depth),
        minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
        featureSubsetStrategy=str(params.get("max_features", "sqrt")),
        seed=SEED,
    )
    if weight_col:
        est.setWeightCol(weight_col)
    return est


def gbt_estimator(params: dict, label_col: str = "label_idx") -> OneVsRest:
    """Multiclass boosting as one-vs-rest binary boosted trees (unweighted, as the reference)."""
    col = params.get("colsample_bytree", 1.0)
    gbt = GBTClassifier(
        maxIter=int(params.get("n_estimators", 20)),
        maxDepth=int(params.get("max_depth", 5)),
        stepSize=float(params.get("learning_rate", 0.1)),
        subsamplingRate=float(params.get("subsample", 1.0)),
        featureSubsetStrategy=str(col) if col < 1.0 else "all",
        seed=SEED,
    )
    return OneVsRest(classifier=gbt, labelCol=label_col, featuresCol="features")


@dataclass
class Fitted:
    model: PipelineModel
    features: list[str]
    kind: str  # "rf" or "ovr"
    seconds: float


def fit_partitions(rows: int, cores: int) -> int | None:
    """Partitions for ``rows`` training rows; None where the table's own are fine (no more than a share for each core)."""
    n = -(-rows // FIT_ROWS)
    return n if n > cores else None


def spread_rows(train: DataFrame, rows: int | None = None) -> DataFrame:
    """A small compressed file holds many rows: deal them so that a task's part does not grow with the table."""
    n = fit_partitions(train.count() if rows is None else rows, train.sparkSession.sparkContext.defaultParallelism)
    return train if n is None else train.repartition(n)


def fit(train: DataFrame, features: list[str], estimator, kind: str) -> Fitted:
    t0 = time.perf_counter()
    model = Pipeline(stages=[assembler(features), estimator]).fit(spread_rows(train))
    return Fitted(model, features, kind, time.perf_counter() - t0)


def rf_train(train: DataFrame, features: list[str], params: dict, label_col: str = "label_idx", weight_col: str | None = "weight") -> Fitted:
    return fit(train, features, rf_estimator(params, label_col, weight_col), "rf")


def gbt_train(train: DataFrame, features: list[str], params: dict, label_col: str = "label_idx") -> Fitted:
    """One boosted ensemble per class against the rest, all grown in the same passes over binned rows (``operators.grow``)."""
    t0 = time.perf_counter()
    rows = binned_rows(spread_rows(train), features, params, label_col)
    model = PipelineModel([assembler(features), boosted(rows, features, params, label_col)])
    return Fitted(model, features, "ovr", time.perf_counter() - t0)


@dataclass
class BinnedRows:
    """Training rows as blocks of bins (``grow.write_blocks``) with the candidate thresholds of every feature."""

    blocks: DataFrame
    features: list[str]
    cuts: list
    classes: int


def binned_rows(rows: DataFrame, features: list[str], params: dict, label_col: str = "label_idx", vector_col: str | None = None) -> BinnedRows:
    """Rows binned for :func:`boosted`, with the bags of the boosting rounds; the features are columns or those of a vector."""
    gbt = gbt_estimator(params, label_col).getClassifier().setLabelCol(label_col)
    vectors = assembler(features).transform(rows) if vector_col is None else rows.withColumnRenamed(vector_col, "features")
    labelled = vectors.select(F.col(label_col).cast("double").alias(label_col), "features")
    cuts = G.candidate_splits(labelled, gbt, SEED)
    x = F.array(*[c(f).cast("double") for f in features]) if vector_col is None else vector_to_array(F.col(vector_col))
    blocks = G.write_blocks(rows, x, label_col, cuts, G.round_bits(gbt.getMaxIter(), gbt.getSubsamplingRate(), SEED))
    return BinnedRows(blocks, list(features), cuts, int(rows.agg(F.max(label_col)).first()[0]) + 1)


def boosted(rows: BinnedRows, features: list[str], params: dict, label_col: str = "label_idx") -> OneVsRestModel:
    """The fitted one-vs-rest model over ``features``, the first of the binned ones."""
    estimator = gbt_estimator(params, label_col)
    gbt = estimator.getClassifier()
    cuts = rows.cuts[: len(features)]
    grown = G.boost(
        rows.blocks, len(rows.features), [len(c) for c in cuts], rows.classes, gbt.getMaxIter(), gbt.getMaxDepth(), gbt.getStepSize(),
        gbt.getFeatureSubsetStrategy(), SEED, gbt.getMinInstancesPerNode(),
    )
    sc = rows.blocks.sparkSession.sparkContext
    java = sc._jvm.org.apache.spark.ml
    models = []
    for k, trees in enumerate(grown):
        roots = G.java_roots(sc, trees, cuts, "variance")
        one = [java.regression.DecisionTreeRegressionModel(f"{gbt.uid}-tree-{k}-{t}", root, len(features)) for t, root in enumerate(roots)]
        weights = G.java_array(sc, sc._jvm.double, [1.0] + [gbt.getStepSize()] * (len(trees) - 1))
        ensemble = java.classification.GBTClassificationModel(f"{gbt.uid}-{k}", G.java_array(sc, java.regression.DecisionTreeRegressionModel, one), weights, len(features), 2)
        model = gbt.copy({gbt.labelCol: f"mc2b${k}"})._copyValues(GBTClassificationModel(ensemble))
        model._transfer_params_to_java()
        models.append(model)
    return estimator._copyValues(OneVsRestModel(models=models))


def probability_column(kind: str) -> Column:
    """Class probabilities as ``array<double>``; one-vs-rest normalises sigmoid(2 * margin)."""
    if kind == "rf":
        return vector_to_array(F.col("probability"))
    raw = vector_to_array(F.col("rawPrediction"))
    sig = F.transform(raw, lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * m)))
    total = F.aggregate(sig, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(sig, lambda x: x / total)


def transform(fitted: Fitted, df: DataFrame) -> DataFrame:
    """The model's columns; one-vs-rest by Spark's own class, as Python's passes every row through Python once a class."""
    if fitted.kind != "ovr":
        return fitted.model.transform(df)
    *first, last = fitted.model.stages
    for stage in first:
        df = stage.transform(df)
    return DataFrame(last._to_java().transform(df._jdf), df.sparkSession)


def predict(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Adds ``probability`` (array), ``pred_idx`` (first argmax) and ``confidence``."""
    out = transform(fitted, df).withColumn("_proba", probability_column(fitted.kind))
    out = out.drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("_proba", E.PROBA)
    return E.add_prediction(out)


def feature_importance(fitted: Fitted) -> list[tuple[str, float]]:
    """Impurity importance per feature (one-vs-rest: mean over the K binary models).  P values."""
    stage = fitted.model.stages[-1]
    if fitted.kind == "rf":
        vals = list(stage.featureImportances.toArray())
    else:
        arrs = [m.featureImportances.toArray() for m in stage.models]
        vals = [sum(a[i] for a in arrs) / len(arrs) for i in range(len(fitted.features))]
    return list(zip(fitted.features, [float(v) for v in vals]))


def importance_frame(spark, fitted: Fitted) -> DataFrame:
    return spark.createDataFrame(feature_importance(fitted), "feature_name string, importance double")


class MacroF1Evaluator(Evaluator):
    """Macro-averaged F1 (Spark's built-in ``f1`` is support-weighted)."""

    def __init__(self, label_col: str = "label_idx", prediction_col: str = "prediction"):
        super().__init__()
        self.label_col = label_col
        self.prediction_col = prediction_col

    def _evaluate(self, dataset: DataFrame) -> float:
        counts = dataset.groupBy(F.col(self.label_col).cast("bigint").alias("t"), F.col(self.prediction_col).cast("bigint").alias("p")).count()
        by_t = counts.groupBy("t").agg(F.sum("count").alias("sup"), F.sum(F.when(F.col("t") == F.col("p"), F.col("count")).otherwise(0)).alias("tp"))
        by_p = counts.groupBy(F.col("p").alias("t")).agg(F.sum("count").alias("pred"))
        cls = by_t.join(by_p, "t", "full").fillna(0)
        f1 = F.when(F.col("sup") + F.col("pred") > 0, 2 * F.col("tp") / (F.col("sup") + F.col("pred"))).otherwise(0.0)
        row = cls.agg(F.avg(f1).alias("m")).first()
        return float(row["m"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def sample_grid(grid: dict, n_iter: int = SEARCH_ITERATIONS, seed: int = SEED) -> list[dict]:
    """``n_iter`` distinct combinations drawn with a seeded generator (all if fewer exist)."""
    keys = list(grid)
    combos = [[]]
    for k in keys:
        combos = [c + [v] for c in combos for v in grid[k]]
    rng = random.Random(seed)
    picked = combos if len(combos) <= n_iter else rng.sample(combos, n_iter)
    return [dict(zip(keys, c)) for c in picked]


def random_search(
    data: DataFrame,
    features: list[str],
    grid: dict,
    kind: str,
    fold_col: str = "fold",
    label_col: str = "label_idx",
    weight_col: str | None = "weight",
    n_iter: int = SEARCH_ITERATIONS,
    parallelism: int = 2,
) -> tuple[dict, float, float]:
    """Seeded random search with K-fold CV on a caller-built fold column; macro F1 decides."""
    combos = sample_grid(grid, n_iter)
    if kind == "rf":
        est = rf_estimator(combos[0], label_col, weight_col)
        maps = []
        for p in combos:
            depth = p.get("max_depth")
            b = ParamGridBuilder()
            b.addGrid(est.numTrees, [int(p["n_estimators"])])
            b.addGrid(est.maxDepth, [MAX_DEPTH_UNLIMITED if depth is None else int(depth)])
            b.addGrid(est.minInstancesPerNode, [int(p.get("min_samples_leaf", 1))])
            maps += b.build()
    else:
        est = gbt_estimator(combos[0], label_col)
        maps = []
        for p in combos:
            g = gbt_estimator(p, label_col).getClassifier()
            b = ParamGridBuilder().addGrid(est.classifier, [g])
            maps += b.build()
    x = spread_rows(assembler(features).transform(data))
    cv = CrossValidator(
        estimator=est,
        estimatorParamMaps=maps,
        evaluator=MacroF1Evaluator(label_col),
        foldCol=fold_col,
        parallelism=parallelism,
        seed=SEED,
    )
    t0 = time.perf_counter()
    model = cv.fit(x)
    secs = time.perf_counter() - t0
    best = int(max(range(len(model.avgMetrics)), key=lambda i: model.avgMetrics[i]))
    return combos[best], float(model.avgMetrics[best]), secs


#: Poisson(1) cumulative probabilities for k = 0..12 (bootstrap multiplicity of a row); what is left is below the
#: resolution of the 30-bit draw.
_POISSON1_CDF = [sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1)) for k in range(13)]
FIT_PARALLELISM = 3
_BITS = 32


def _draw(row_key: Column, tree: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(row_key, F.lit(tree), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def poisson_weight(row_key: Column, tree: int, seed: int = SEED) -> Column:
    """Deterministic bootstrap multiplicity of a row in tree ``tree`` (Poisson(1) by inverse CDF)."""
    u = _draw(row_key, tree, seed)
    w = F.lit(float(len(_POISSON1_CDF)))
    for k in range(len(_POISSON1_CDF) - 1, -1, -1):
        w = F.when(u < F.lit(_POISSON1_CDF[k]), F.lit(float(k))).otherwise(w)
    return w


def in_bag_bits(row_key: Column, n_trees: int, seed: int = SEED) -> Column:
    """``array<bigint>``, 32 trees a word: bit t is set if the row is in tree t's bag (its multiplicity is not 0)."""
    words = []
    for lo in range(0, n_trees, _BITS):
        word = F.lit(0).cast("bigint")
        for t in range(lo, min(lo + _BITS, n_trees)):
            word = word.bitwiseOR(F.when(_draw(row_key, t, seed) < F.lit(_POISSON1_CDF[0]), F.lit(0)).otherwise(F.lit(1 << (t - lo))).cast("bigint"))
        words.append(word)
    return F.array(*words)


def _out_of_bag(bits: Column, tree: int) -> Column:
    return F.get(bits, F.lit(tree // _BITS)).bitwiseAND(F.lit(1 << (tree % _BITS))) == 0


def bagged_trees(rows: DataFrame, features: list[str], params: dict, n: int, label_col: str, weight_col: str | None, key_col: str) -> tuple[BinnedRows, list, list]:
    """The binned rows with their multiplicities, ``n`` trees of ``grow`` and the same trees as one-tree forests of Spark.

    Tree t is fitted on the rows of its hashed bag (:func:`poisson_weight`).
    """
    forest = rf_estimator(dict(params, n_estimators=1), label_col, weight_col).setBootstrap(False)
    labelled = assembler(features).transform(rows).select(F.col(label_col).cast("double").alias(label_col), "features", *([weight_col] if weight_col else []))
    cuts = G.candidate_splits(labelled, forest, SEED)
    classes = int(rows.agg(F.max(label_col)).first()[0]) + 1
    draws = F.array(*[_draw(F.col(key_col), t, SEED) for t in range(n)])
    blocks = G.write_blocks(rows, F.array(*[c(f).cast("double") for f in features]), label_col, cuts, draws, _POISSON1_CDF, weight_col)
    grown = G.bagged(blocks, [len(x) for x in cuts], classes, n, forest.getMaxDepth(), forest.getFeatureSubsetStrategy(), SEED, forest.getMinInstancesPerNode())
    sc = rows.sparkSession.sparkContext
    java = sc._jvm.org.apache.spark.ml.classification
    models = []
    for t, root in enumerate(G.java_roots(sc, grown, cuts, "gini")):
        tree = java.DecisionTreeClassificationModel(f"{forest.uid}-tree-{t}", root, len(features), classes)
        one = G.java_array(sc, java.DecisionTreeClassificationModel, [tree])
        model = forest._copyValues(RandomForestClassificationModel(java.RandomForestClassificationModel(f"{forest.uid}-{t}", one, len(features), classes)))
        model._transfer_params_to_java()
        models.append(model)
    return BinnedRows(blocks, list(features), cuts, classes), grown, models


def oob_votes(rows: BinnedRows, trees: list) -> DataFrame:
    """``(label, votes, voters)``, one row per training row.

    ``votes`` sums the class probabilities of the trees whose bag misses the row, ``voters`` counts these trees.  A block
    of rows meets all trees at once: nothing is shuffled.
    """
    p, k, n_trees = len(rows.features), rows.classes, len(trees)
    shares = [t.arrays(lambda stats: stats[:-1] / max(stats[:-1].sum(), 1e-300)) for t in trees]

    def vote(batches):
        for batch in batches:
            for block in G.each_block(batch):
                n = block["n"]
                bins = np.frombuffer(block["bins"], dtype=np.uint8).reshape(p, n)
                bag = np.frombuffer(block["bag"], dtype=np.uint8).reshape(n_trees, n)
                votes, voters = np.zeros((n, k)), np.zeros(n, dtype=np.int64)
                for t, tree in enumerate(shares):
                    outside = np.flatnonzero(bag[t] == 0)
                    votes[outside] += tree[4][G.walk(np.ascontiguousarray(bins[:, outside]), tree)]
                    voters[outside] += 1
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(np.round(votes, 9).reshape(-1)))
                label = np.frombuffer(block["label"], dtype=np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(label), lists, pa.array(voters)], ["label", "votes", "voters"])

    return rows.blocks.mapInArrow(vote, "label long, votes array<double>, voters long")


def rf_oob(
    train: DataFrame,
    features: list[str],
    params: dict,
    n_trees: int | None = None,
    label_col: str = "label_idx",
    weight_col: str | None = "weight",
    key_col: str = "row_key",
    parallelism: int = FIT_PARALLELISM,  # kept for callers: the trees no longer are separate fits
) -> tuple[DataFrame, list]:
    """Bagged forest with out-of-bag accuracy (Spark ML has no OOB score).

    Each tree (``n_trees``, by default the forest's ``n_estimators``) is a one-tree forest (random feature subsets per
    node) fitted on rows weighted by a hashed Poisson(1) multiplicity times the class weight; all trees grow in the same
    passes over binned rows (``operators.grow``) and share their candidate thresholds, as the trees of a forest do.
    The binned rows and their multiplicities are written once; a row votes only through trees whose bag misses it.  Vote sums
    are rounded to nine digits, so that equal votes tie however they were added up; the smaller class index wins.
    Returns a one-row frame (oob_accuracy, oob_rows, rows_without_vote, n_trees) and the fitted trees; the accuracy is
    null if no row has a vote.
    """
    n = int(params.get("n_estimators", 100)) if n_trees is None else n_trees
    rows, trees, models = bagged_trees(train, features, params, n, label_col, weight_col, key_col)
    votes = oob_votes(rows, trees)
    pred = F.array_position(F.col("votes"), F.array_max("votes")) - 1
    voted = F.col("voters") > 0
    summary = votes.agg(
        F.avg(F.when(voted, (pred == F.col("label")).cast("double"))).alias("oob_accuracy"),
        F.count_if(voted).cast("bigint").alias("oob_rows"),
        F.count_if(~voted).cast("bigint").alias("rows_without_vote"),
    ).withColumn("n_trees", F.lit(n))
    return summary, models
