"""Level-wise tree growth on binned rows, for many trees in one pass over the data.

Spark ML's tree algorithm (candidate thresholds of a sample, histograms per node, best gain) with another layout.  Spark
fits one ensemble at a time and keeps an object per row for it, so boosting K one-vs-rest ensembles of T trees reads
K x T x depth times what no longer fits in memory.  Here the rows are binned once, a byte per feature, and written in
column-wise blocks; one pass per level fills the histograms of every model with numpy, Spark adds them up by cell, the
driver picks the splits (nodes x features x bins numbers, as in Spark ML).

The candidates come from Spark's own ``findSplits`` and the in-bag rows of a boosting round from the generator and seeds
Spark's subsampling uses, so a boosted ensemble is the one that ``GBTClassifier`` fits to the same partitions (up to
splits that tie but for the order of a sum; where a node sees a random subset of the features, the subset is another one).
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import scratch_dir, ship_package

#: Rows of a block; cells of the histograms that one pass fills (more nodes take more passes).
BLOCK_ROWS = 32_768
PASS_CELLS = 4_000_000
#: Files of blocks for each core; larger files are read in several tasks.
FILES_PER_CORE = 4
#: Boosting rounds after which the rows' margins are written, so that a pass does not walk ever more trees.
STATE_ROUNDS = 10
#: Levels of up to this many nodes are walked by comparing whole columns, wider ones by look-up.
WIDE_LEVEL = 8
EPSILON = 2.0**-52
_BITS = 32


def candidate_splits(rows: DataFrame, estimator: Estimator, seed: int) -> list[np.ndarray]:
    """Candidate thresholds per feature, found by Spark ML itself from a sample of ``rows`` (label, features[, weight])."""
    sc = rows.sparkSession.sparkContext
    jvm = sc._jvm
    module = lambda name: getattr(getattr(jvm, name + "$"), "MODULE$")
    none = module("scala.None")
    estimator._transfer_params_to_java()
    instances = module("org.apache.spark.ml.util.DatasetUtils").extractInstances(estimator._java_obj, rows._jdf, none)
    strategy = jvm.org.apache.spark.mllib.tree.configuration.Strategy.defaultStrategy("Regression")
    strategy.setMaxBins(estimator.getMaxBins())
    metadata = module("org.apache.spark.ml.tree.impl.DecisionTreeMetadata").buildMetadata(instances, strategy, 1, "all")
    found = module("org.apache.spark.ml.tree.impl.RandomForest").findSplits(instances, metadata, seed)
    return [np.array([s.threshold() for s in feature], dtype=float) for feature in found]


def features_per_node(strategy: str, n: int) -> int:
    """Spark's ``featureSubsetStrategy`` for a given number of features."""
    named = {"all": n, "auto": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "onethird": math.ceil(n / 3.0)}
    if strategy in named:
        return named[strategy]
    return min(int(strategy), n) if strategy.isdigit() and int(strategy) > 0 else math.ceil(float(strategy) * n)


def round_bits(rounds: int, rate: float, seed: int) -> Column:
    """``array<bigint>``, 32 rounds a word: bit r is set if the row is in round r's subsample (Spark's seeds and generator)."""
    words = []
    for lo in range(0, rounds, _BITS):
        word = F.lit(0).cast("bigint")
        for r in range(lo, min(lo + _BITS, rounds)):
            drawn = F.when(F.rand(seed + r + 1) < F.lit(rate), F.lit(1 << (r - lo))).otherwise(F.lit(0)) if rate < 1.0 else F.lit(1 << (r - lo))
            word = word.bitwiseOR(drawn.cast("bigint"))
        words.append(word)
    return F.array(*words)


def write_blocks(rows: DataFrame, x: Column, label_col: str, cuts: list[np.ndarray], bag: Column, thresholds: list[float] | None = None, weight_col: str | None = None) -> DataFrame:
    """Rows as blocks ``(n, bins, label, bag, weight, margin)`` of plain arrays, written once; ``x`` holds a row's features.

    ``bag``: words of :func:`round_bits`, kept as they are, or draws in [0, 1) that become multiplicities by
    ``thresholds`` (cumulative probabilities).  Missing or infinite features and missing labels are an error, as in Spark ML.
    """
    spark = rows.sparkSession
    ship_package(spark)
    p = len(cuts)
    picked = rows.select(
        x.alias("x"),
        F.col(label_col).cast("double").alias("label"),
        bag.alias("bag"),
        (F.col(weight_col) if weight_col else F.lit(1.0)).cast("double").alias("weight"),
    )

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            label = batch.column("label").to_numpy(zero_copy_only=False)
            if not (np.isfinite(x).all() and np.isfinite(label).all()):
                raise ValueError("training rows must not hold missing or infinite features, nor missing labels")
            bins = np.empty((p, len(x)), dtype=np.uint8)
            for f in range(p):
                bins[f] = np.searchsorted(cuts[f], x[:, f], side="left")
            given = _matrix(batch.column("bag"))
            if thresholds is not None:
                given = np.searchsorted(np.asarray(thresholds), given, side="right").astype(np.uint8)
            weight = batch.column("weight").to_numpy(zero_copy_only=False) if weight_col else np.empty(0)
            held.append((bins, label.astype(np.int32), np.ascontiguousarray(given.T), weight))
            n += len(x)
            if n >= BLOCK_ROWS:
                yield _block(held)
                held, n = [], 0
        if n:
            yield _block(held)

    path = scratch_dir(spark, "binned")
    blocks = picked.mapInArrow(pack, "n int, bins binary, label binary, bag binary, weight binary, margin binary")
    blocks.repartition(FILES_PER_CORE * spark.sparkContext.defaultParallelism).write.parquet(path)  # whatever the layout of the rows
    return spark.read.parquet(path)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def each_block(batch):
    """The blocks of a batch one by one."""
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _block(held: list) -> pa.RecordBatch:
    bins, label, bag, weight = (np.concatenate([h[i] for h in held], axis=-1) for i in range(4))
    columns = [pa.array([v], pa.binary()) for v in (bins.tobytes(), label.tobytes(), bag.tobytes(), weight.tobytes(), b"")]
    return pa.RecordBatch.from_arrays([pa.array([len(label)], pa.int32()), *columns], ["n", "bins", "label", "bag", "weight", "margin"])


@dataclass
class GrownTree:
    """Nodes in order of creation; the right child follows the left one.  ``cut``: a bin up to it goes left."""

    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [255])
    left: list = field(default_factory=lambda: [-1])
    gain: list = field(default_factory=lambda: [0.0])
    valid: list = field(default_factory=lambda: [True])
    level: list = field(default_factory=lambda: [0])
    stats: list = field(default_factory=lambda: [None])
    parent: list = field(default_factory=lambda: [-1])

    def arrays(self, value=None):
        """What a pass needs: (feature, cut, left or itself, nodes by level, value per node)."""
        left = np.array(self.left)
        levels = [[j for j, lv in enumerate(self.level) if lv == d and left[j] >= 0] for d in range(max(self.level) + 1)]
        stay = np.where(left < 0, np.arange(len(left)), left)
        v = None if value is None else np.array([value(s) for s in self.stats])
        return np.maximum(np.array(self.feature), 0), np.array(self.cut), stay, [lv for lv in levels if lv], v

    def add_children(self, j: int, feature: int, cut: int, gain: float, left, right) -> None:
        self.feature[j], self.cut[j], self.gain[j], self.left[j] = feature, cut, gain, len(self.left)
        for stats in (left, right):
            self.feature.append(-1)
            self.cut.append(255)
            self.left.append(-1)
            self.gain.append(0.0)
            self.valid.append(True)
            self.level.append(self.level[j] + 1)
            self.stats.append(stats)
            self.parent.append(j)


def walk(bins: np.ndarray, tree) -> np.ndarray:
    """The node each row has come to."""
    feature, cut, stay, levels, _ = tree
    n = bins.shape[1]
    node = np.zeros(n, dtype=np.int16 if len(stay) < 32_000 else np.int32)
    flat, at = bins.reshape(-1), None
    for nodes in levels:
        if len(nodes) <= WIDE_LEVEL:
            step = np.zeros_like(node)
            for j in nodes:
                here = node == j
                step += here * node.dtype.type(stay[j] - j)
                step += here & (bins[feature[j]] > cut[j])
            node += step
        else:
            at = np.arange(n) if at is None else at
            value = flat[feature[node] * n + at]
            node = (stay[node] + (value > cut[node])).astype(node.dtype)
    return node


def _boost_work(block, models, size, bins, label, bag):
    """Histograms (count, sum, sum of squares of the residuals) of one block for every one-vs-rest model."""
    p, nb = bins.shape[0], size
    r = models[0]["round"]
    inside = np.flatnonzero((bag[r // _BITS] >> (r % _BITS)) & 1)
    whole = len(inside) == bins.shape[1]
    bins = bins if whole else np.ascontiguousarray(bins[:, inside])
    label = label if whole else label[inside]
    start = np.frombuffer(block["margin"], dtype=float).reshape(len(models), -1) if block["margin"] else None
    for i, m in enumerate(models):
        y = np.where(label == m["target"], 1.0, -1.0)
        if r == 0:
            g = y
        else:
            margin = _margin(bins, m["trees"], None if start is None else start[i][inside])
            g = 4.0 * y / (1.0 + np.exp(2.0 * y * margin))
        base = m["slot"][walk(bins, m["tree"])].astype(np.int64) * nb
        cells = (len(m["features"]) + 1) * nb  # the last slot takes the rows of other nodes
        g2 = g * g
        for f in range(p):
            key = base + bins[f]
            m["hist"][f, :, 0] += np.bincount(key, minlength=cells)
            m["hist"][f, :, 1] += np.bincount(key, g, cells)
            m["hist"][f, :, 2] += np.bincount(key, g2, cells)


def _margin(bins: np.ndarray, trees: list, start) -> np.ndarray:
    margin = np.zeros(bins.shape[1]) if start is None else start.copy()
    for weight, tree in trees:
        margin += weight * tree[4][walk(bins, tree)]
    return margin


def _forest_work(block, models, size, bins, label, bag):
    """Histograms (weight per class, rows) of one block for every bagged tree, over the features its nodes drew."""
    nb, n = size, bins.shape[1]
    weight = np.frombuffer(block["weight"], dtype=float)
    for m in models:
        inside = np.flatnonzero(bag[m["target"]])
        mine = np.ascontiguousarray(bins[:, inside])
        w, y = bag[m["target"]][inside] * (weight[inside] if len(weight) else 1.0), label[inside]
        slot = m["slot"][walk(mine, m["tree"])]
        active = np.flatnonzero(slot < len(m["features"]))
        if len(active) < len(slot):
            mine, w, y, slot = np.ascontiguousarray(mine[:, active]), w[active], y[active], slot[active]
        n, k = mine.shape[1], m["hist"].shape[2] - 1
        flat, at, cells = mine.reshape(-1), np.arange(mine.shape[1]), (len(m["features"]) + 1) * nb
        for j in range(m["features"].shape[1]):
            key = slot.astype(np.int64) * nb + flat[m["features"][slot, j] * n + at]
            m["hist"][j, :, :k] += np.bincount(key * k + y, w, cells * k).reshape(cells, k)
            m["hist"][j, :, k] += np.bincount(key, minlength=cells)


def _pass(blocks: DataFrame, work, models: list[dict], binned: int, p: int, bins: int, width: int, words: int, bag_type) -> dict:
    """One pass over the blocks: ``{model: histogram (features, nodes, bins, width)}``."""

    def fill(batches):
        for m in models:
            m["hist"] = np.zeros((m["features"].shape[1], (len(m["features"]) + 1) * bins, width))
        for batch in batches:
            for block in each_block(batch):
                n = block["n"]
                b = np.frombuffer(block["bins"], dtype=np.uint8).reshape(binned, n)[:p]
                bag = np.frombuffer(block["bag"], dtype=bag_type).reshape(words, n)
                work(block, models, bins, b, np.frombuffer(block["label"], dtype=np.int32), bag)
        for i, m in enumerate(models):
            hist = m["hist"].reshape(len(m["hist"]), len(m["features"]) + 1, bins, width)[:, :-1].reshape(-1, width)
            cells = np.flatnonzero(hist.any(axis=1))
            columns = [pa.array(np.full(len(cells), i, dtype=np.int32)), pa.array(cells), *[pa.array(np.ascontiguousarray(hist[cells, v])) for v in range(width)]]
            yield pa.RecordBatch.from_arrays(columns, ["model", "cell", *[f"v{v}" for v in range(width)]])

    values = [f"v{v}" for v in range(width)]
    found = blocks.mapInArrow(fill, "model int, cell long, " + ", ".join(f"{v} double" for v in values))
    added = found.groupBy("model", "cell").agg(*[F.sum(v).alias(v) for v in values]).toArrow()
    model, cell = added.column("model").to_numpy(), added.column("cell").to_numpy()
    stats = np.stack([added.column(v).to_numpy() for v in values], axis=1)
    out = {}
    for i, m in enumerate(models):
        hist = np.zeros((m["features"].shape[1] * len(m["features"]) * bins, width))
        hist[cell[model == i]] = stats[model == i]
        out[i] = hist.reshape(m["features"].shape[1], len(m["features"]), bins, width)
    return out


def variance(stats: np.ndarray) -> np.ndarray:
    count = np.where(stats[..., 0] == 0, 1.0, stats[..., 0])
    return np.where(stats[..., 0] == 0, 0.0, (stats[..., 2] - stats[..., 1] * stats[..., 1] / count) / count)


def gini(stats: np.ndarray) -> np.ndarray:
    total = stats[..., :-1].sum(axis=-1)
    share = stats[..., :-1] / np.where(total == 0, 1.0, total)[..., None]
    return np.where(total == 0, 0.0, 1.0 - (share * share).sum(axis=-1))


def _best_split(hist: np.ndarray, features: np.ndarray, n_cuts: list[int], own, impurity, counts, least: float):
    """(feature, cut, gain, left, right) of the first split with the largest gain, or None; ``hist`` (features, bins, width)."""
    best = None
    for j, f in enumerate(features):
        if n_cuts[f] == 0:
            continue
        upto = np.cumsum(hist[j, : n_cuts[f] + 1], axis=0)
        left, right = upto[:-1], upto[-1] - upto[:-1]
        (lw, lr), (rw, rr) = counts(left), counts(right)
        total = np.where(lw + rw == 0, 1.0, lw + rw)
        gain = impurity(own) - lw / total * impurity(left) - rw / total * impurity(right)
        gain = np.where((lr < least) | (rr < least) | (gain < 0.0), -np.inf, gain)
        at = int(np.argmax(gain))
        if np.isfinite(gain[at]) and (best is None or gain[at] > best[2]):
            best = (int(f), at, float(gain[at]), left[at], right[at])
    return best


def grow_level(blocks, binned, work, trees: list[GrownTree], specs: list[dict], n_cuts: list[int], level: int, max_depth: int, draw, impurity, counts, least: float, width: int, words: int, bag_type) -> bool:
    """Split every open node of a level; False once there was none."""
    p, bins = len(n_cuts), max(n_cuts) + 1
    still = lambda t, j: t.stats[j] is None or (level < max_depth and abs(float(impurity(t.stats[j]))) >= EPSILON)
    todo = [(i, j) for i, t in enumerate(trees) for j in range(len(t.left)) if t.level[j] == level and still(t, j)]
    if not todo:
        return False
    drawn = {(i, j): draw(i) for i, j in todo}
    per_pass = max(1, PASS_CELLS // (len(drawn[todo[0]]) * bins * width))
    for lo in range(0, len(todo), per_pass):
        part = todo[lo : lo + per_pass]
        models, opened = [], []
        for i, t in enumerate(trees):
            nodes = [j for k, j in part if k == i]
            if nodes:
                slot = np.full(len(t.left), len(nodes))
                slot[nodes] = np.arange(len(nodes))
                models.append(dict(specs[i], tree=t.arrays(), slot=slot, features=np.array([drawn[i, j] for j in nodes])))
                opened.append((t, nodes))
        found = _pass(blocks, work, models, binned, p, bins, width, words, bag_type)
        for k, (t, nodes) in enumerate(opened):
            for s, j in enumerate(nodes):
                hist, features = found[k][:, s], models[k]["features"][s]
                if t.stats[j] is None:
                    t.stats[j] = hist[0].sum(axis=0)
                best = _best_split(hist, features, n_cuts, t.stats[j], impurity, counts, least)
                if best is None:
                    t.valid[j] = False
                elif best[2] > 0.0 and level < max_depth:
                    t.add_children(j, *best)
    return True


def _mean(stats: np.ndarray) -> float:
    return float(stats[1] / stats[0]) if stats[0] else 0.0


def boost(blocks: DataFrame, binned: int, n_cuts: list[int], classes: int, rounds: int, max_depth: int, rate: float, strategy: str, seed: int, least: int = 1) -> list[list[GrownTree]]:
    """One boosted ensemble (log loss, as Spark's) per class against the rest: all classes grow in the same passes.

    The blocks hold ``binned`` features; the ensemble uses the first ``len(n_cuts)``.
    """
    p, words = len(n_cuts), -(-rounds // _BITS)
    take = features_per_node(strategy, p)
    counts = lambda s: (s[..., 0], s[..., 0])
    grown = [[] for _ in range(classes)]
    kept = 0
    for r in range(rounds):
        trees = [GrownTree() for _ in range(classes)]
        rng = random.Random(seed + r)
        draw = lambda _: list(range(p)) if take == p else sorted(rng.sample(range(p), take))  # noqa: E731, B023
        before = [[(1.0 if t == 0 else rate, tree.arrays(_mean)) for t, tree in enumerate(ts) if t >= kept] for ts in grown]
        if len(before[0]) >= STATE_ROUNDS:
            blocks, kept = _write_margins(blocks, before, binned), r
            before = [[] for _ in range(classes)]
        specs = [{"target": k, "round": r, "trees": before[k]} for k in range(classes)]
        level = 0
        while grow_level(blocks, binned, _boost_work, trees, specs, n_cuts, level, max_depth, draw, variance, counts, least, 3, words, np.int64):
            level += 1
        for k in range(classes):
            grown[k].append(_pruned(trees[k], _mean))
    return grown


def _write_margins(blocks: DataFrame, trees: list[list], p: int) -> DataFrame:
    def add(batches):
        for batch in batches:
            out = []
            for block in each_block(batch):
                b = np.frombuffer(block["bins"], dtype=np.uint8).reshape(p, block["n"])
                start = np.frombuffer(block["margin"], dtype=float).reshape(len(trees), -1) if block["margin"] else None
                block["margin"] = np.stack([_margin(b, t, None if start is None else start[k]) for k, t in enumerate(trees)]).tobytes()
                out.append(block)
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    path = scratch_dir(blocks.sparkSession, "margins")
    blocks.mapInArrow(add, blocks.schema).write.parquet(path)
    return blocks.sparkSession.read.parquet(path)


def bagged(blocks: DataFrame, n_cuts: list[int], classes: int, n_trees: int, max_depth: int, strategy: str, seed: int, least: int = 1) -> list[GrownTree]:
    """``n_trees`` classification trees, each on the rows its multiplicities keep; every node draws its features."""
    p = len(n_cuts)
    take = features_per_node(strategy, p)
    rngs = [random.Random(seed + t) for t in range(n_trees)]
    draw = lambda i: list(range(p)) if take == p else sorted(rngs[i].sample(range(p), take))
    counts = lambda s: (s[..., :-1].sum(axis=-1), s[..., -1])
    trees = [GrownTree() for _ in range(n_trees)]
    specs = [{"target": t} for t in range(n_trees)]
    level = 0
    while grow_level(blocks, p, _forest_work, trees, specs, n_cuts, level, max_depth, draw, gini, counts, least, classes + 1, n_trees, np.uint8):
        level += 1
    return [_pruned(t, _majority) for t in trees]


def _majority(stats: np.ndarray) -> float:
    return float(np.argmax(stats[:-1]))


def _pruned(tree: GrownTree, predict) -> GrownTree:
    """Splits whose two leaves predict the same become leaves, from below (Spark's pruning)."""
    for j in reversed(range(len(tree.left))):
        lc = tree.left[j]
        if lc >= 0 and tree.left[lc] < 0 and tree.left[lc + 1] < 0 and predict(tree.stats[lc]) == predict(tree.stats[lc + 1]):
            tree.left[j], tree.feature[j], tree.cut[j] = -1, -1, 255
    return tree


def java_roots(sc, trees: list[GrownTree], cuts: list[np.ndarray], kind: str) -> list:
    """The trees as Spark's own nodes."""
    jvm = sc._jvm
    nodes, impurities = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.mllib.tree.impurity
    leaf, inner, split, vectors = nodes.LeafNode, nodes.InternalNode, nodes.ContinuousSplit, jvm.org.apache.spark.mllib.linalg.Vectors
    impurity, predict, calculator = (variance, _mean, impurities.VarianceCalculator) if kind == "variance" else (gini, _majority, impurities.GiniCalculator)
    roots = []
    for tree in trees:
        made, reached = {}, [0]
        for j in reached:
            if tree.left[j] >= 0:
                reached += [tree.left[j], tree.left[j] + 1]
        for j in reversed(reached):
            stats = tree.stats[j]
            numbers, raw = (stats, stats[0]) if kind == "variance" else (stats[:-1], stats[-1])
            calc = calculator(vectors.parse("[" + ",".join(repr(float(v)) for v in numbers) + "]").toArray(), int(raw))
            value, own = predict(stats), float(impurity(stats))
            if tree.left[j] < 0:
                made[j] = leaf(value, own if tree.valid[j] else -1.0, calc)
            else:
                at = split(tree.feature[j], float(cuts[tree.feature[j]][tree.cut[j]]))
                made[j] = inner(value, own, tree.gain[j], made[tree.left[j]], made[tree.left[j] + 1], at, calc)
        roots.append(made[0])
    return roots


def java_array(sc, kind, items: list):
    out = sc._gateway.new_array(kind, len(items))
    for i, x in enumerate(items):
        out[i] = x
    return out
