import math

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from flowlens.llm.topk import top_inner_products
from flowlens.llm.vptree import FACTOR, build_tree, nearest_neighbours, search_tree

SCHEMA = "vec_id long, embedding array<float>, row string, dim string, score string"


def sample(n=400, dim=9, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=dim))]) for i in range(n)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)] + [(2000, [0.0] * dim), (2020, None), (2040, [1.0] * (dim - 1) + [None])]
    rows += [(2060, [1.0] * (dim - 1) + [math.nan]), (2080, [math.inf] + [1.0] * (dim - 1)), (None, rows[7][1]), (2100, []), (2200, [1.0, 2.0]), (2300, [0.5, 3.0]),
             (20, rows[20][1]), (100, rows[100][1])]
    return rows


def brute(rows, step, k, value, nonzero):
    good = [(r, i, v) for r, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (any(v) or not nonzero)]
    out = []
    for r, i, v in good:
        if i % step == 0:
            hits = sorted((-value(v, w), j) for s, j, w in good if s != r and len(w) == len(v))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(hits, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "r", "d", "s") for i, v in rows], SCHEMA).repartition(3)


def test_exact_top_k(spark):
    rows = sample()
    whole = lambda v, w: sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(v, w))
    got = top_inner_products(frame(spark, rows), F.col("vec_id") % 100 == 0, k=7, shard_rows=90, block_queries=4)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 100, 7, whole, False)
    huge = [(i, [float(np.float32(x)) for x in v]) for i, v in ((0, [1e6, 3.0]), (100, [-2e6, 1.5]), (1, [123456.7, 1e3]))]
    got = top_inner_products(frame(spark, huge), F.col("vec_id") % 100 == 0, k=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(huge, 100, 3, whole, False)
    assert top_inner_products(frame(spark, rows).limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_factor_one_is_exact(spark):
    rows = sample()
    dot = lambda v, w: sum(a * b for a, b in zip(v, w))
    got = nearest_neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0, k=6, factor=1.0, shard_rows=300, block_queries=10)
    want = brute(rows, 20, 6, dot, True)
    got = sorted(tuple(r) for r in got.collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want))
    assert nearest_neighbours(frame(spark, rows).limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_with_the_production_factor(spark):
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    ids, matrix = np.array(table["vec_id"]), np.array(table["embedding"], np.float64)
    scores = matrix @ matrix.T
    np.fill_diagonal(scores, -np.inf)
    truth = {int(ids[q]): set(ids[np.argsort(-scores[q])[:20]].tolist()) for q in range(len(ids)) if ids[q] % 20 == 0}
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found: dict[int, set] = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 20 == 0, factor=FACTOR).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(truth[q] & found[q]) / 20 for q in truth]) >= 0.9


def test_recall_does_not_depend_on_the_norms():
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(4000, 16))
    unit += 1.5 * rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    ids = np.arange(4000)
    for lengths in (np.where(ids == 7, 3.0, 1.0), np.where(ids == 7, 1e160, 1.0), np.exp(0.2 * rng.normal(size=4000)), np.exp(2.0 * rng.normal(size=4000))):
        matrix = unit * lengths[:, None]
        asked = np.flatnonzero(ids % 40 == 0)
        scores = matrix[asked] @ matrix.T
        scores[np.arange(len(asked)), asked] = -np.inf
        truth = [set(x.tolist()) for x in np.argsort(-scores, axis=1)[:, :20]]
        tree = build_tree(ids, ids, matrix)
        for factor, least in ((1.0, 1.0), (FACTOR, 0.9)):
            found = [set() for _ in asked]
            for q, hit in zip(*[x.tolist() for x in search_tree(tree, ids[asked], ids[asked], matrix[asked], 20, factor)[1:4:2]]):
                found[q // 40].add(hit)
            assert np.mean([len(a & b) / 20 for a, b in zip(truth, found)]) >= least


def test_equal_vectors_of_different_shards_score_alike():
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(500, 48))
    ids, asked = np.arange(500), rng.normal(size=(7, 48))
    large = build_tree(ids, ids, matrix)
    small = build_tree(ids[:30] + 1000, ids[:30] + 1000, matrix[:30])
    names = np.arange(7) + 5000
    one = {(q, i): s for q, i, s in zip(*[search_tree(large, names, names, asked, 500, 1.0)[c].tolist() for c in (1, 3, 4)])}
    two = {(q, i - 1000): s for q, i, s in zip(*[search_tree(small, names, names, asked, 30, 1.0)[c].tolist() for c in (1, 3, 4)])}
    assert len(two) == 210 and all(one[x] == s for x, s in two.items())
