"""Approximate nearest neighbours by vantage-point trees, one forest per shard, with relaxed triangle-inequality pruning.

A shard's vectors are cut into bands of nearly equal norm, the longest first; each band has a tree over the vectors'
directions.  A node keeps the range of distances from its vantage point to each half; the triangle inequality bounds a
query's distance to the half from below, and the half is skipped if ``factor`` times that bound exceeds the distance at
which even the band's longest vector could not beat the query's k-th best inner product so far.  Factor one is exact
search; a larger one skips more.  Distances between directions do not bunch up however the norms differ.  Equal vectors
are one point of the tree with all their ids, so copies neither deepen it nor crowd a leaf.
"""

from __future__ import annotations

import pickle
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame

from flowlens.llm.vectors import search_blocks, usable_rows

#: Prunes a half if FACTOR times its lower bound is beyond the k-th best distance; recall is measured in the tests.
FACTOR = 4.0
LEAF = 64
NEIGHBOURS = 20
#: Largest ratio of norms within a band.
BAND = 1.05
#: Points kept beyond the k-th best: matrix products may differ in their last bits, the final scores do not.
SPARE = 8


def norms_of(matrix: np.ndarray) -> np.ndarray:
    """Euclidean norms that neither overflow nor vanish on the way."""
    most = np.abs(matrix).max(axis=1)
    scaled = matrix / most[:, None]
    return most * np.sqrt((scaled * scaled).sum(axis=1))


def _tree(points: np.ndarray, inside: np.ndarray, leaf: int) -> tuple[np.ndarray, list[tuple]]:
    """(order, nodes) over the points ``inside``.

    A node: (vantage point, nearest and farthest of the near half, the same of the far half, near child, far child), a
    leaf: (-1, ..., begin, end) of its points in ``order``.
    """
    order = inside[np.random.default_rng(len(inside)).permutation(len(inside))]
    nodes: list[tuple] = []
    todo = [(0, len(order), -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        if parent >= 0:
            node = list(nodes[parent])
            node[5 + side] = len(nodes)
            nodes[parent] = tuple(node)
        if hi - lo <= leaf:
            nodes.append((-1, 0.0, 0.0, 0.0, 0.0, lo, hi))
            continue
        part = order[lo:hi]
        centre = part[0]
        gap = points[part] - points[centre]
        d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        half = (hi - lo) // 2
        rank = np.argpartition(d, half)
        order[lo:hi], d = part[rank], d[rank]
        nodes.append((int(centre), d[:half].min(), d[:half].max(), d[half:].min(), d[half:].max(), -1, -1))
        me = len(nodes) - 1
        todo += [(lo + half, hi, me, 1), (lo, lo + half, me, 0)]
    return order, nodes


def build_tree(rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray, leaf: int = LEAF) -> bytes:
    """Serialise the bands' trees over rows sorted by (id, row)."""
    _, first, back = np.unique(matrix, axis=0, return_index=True, return_inverse=True)
    by_first = np.argsort(first, kind="stable")  # points in the order of their smallest id
    point = np.empty(len(first), np.int64)
    point[by_first] = np.arange(len(first))
    owner = point[back.reshape(-1)]
    members = np.argsort(owner, kind="stable")
    begin = np.searchsorted(owner[members], np.arange(len(first) + 1))
    plain = matrix[first[by_first]]
    norms = norms_of(plain)
    units = plain / norms[:, None]
    falling = np.argsort(-norms, kind="stable")
    bands, lo = [], 0
    while lo < len(falling):
        most = norms[falling[lo]]
        hi = max(lo + 1, int(np.searchsorted(-norms[falling], -most / BAND, side="right")))
        bands.append((most, norms[falling[hi - 1]], *_tree(units, falling[lo:hi].copy(), leaf)))
        lo = hi
    return pickle.dumps((plain, bands, rows[members], ids[members], begin), protocol=5)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows, added up in one order whatever else is in the arrays."""
    return (a * b).sum(axis=1)


def search_tree(tree: bytes, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
    """Hits of a block of queries: all queries walk a tree together, each leaving where it may prune."""
    points, bands, row_of, id_of, begin = pickle.loads(tree)
    norms, length = norms_of(points), norms_of(queries)
    units, probe = points / norms[:, None], queries / length[:, None]
    n, want = len(queries), k + 1 + SPARE  # one more: the query's own row is dropped later
    best = np.full((n, want), -np.inf)  # inner products of the query's direction
    who = np.full((n, want), len(points))
    reach = np.empty(n)

    def reaches(at: np.ndarray, most: float, least: float) -> np.ndarray:
        """Distance of directions beyond which no vector of the band beats the k-th best."""
        worst = best[at, k]
        cosine = worst / np.where(worst >= 0, most, least)
        return np.where(np.isfinite(worst), np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine)), np.inf)

    def visit(inside: np.ndarray, at: np.ndarray, most: float, least: float) -> None:
        inside = np.sort(inside)
        score = (probe[at] @ units[inside].T) * norms[inside]
        some = score.max(axis=1) >= best[at, -1]
        at, score = at[some], score[some]
        if not len(at):
            return
        scores = np.concatenate([best[at], score], axis=1)
        names = np.concatenate([who[at], np.broadcast_to(inside, score.shape)], axis=1)
        by_name = np.argsort(names, axis=1, kind="stable")
        scores, names = np.take_along_axis(scores, by_name, 1), np.take_along_axis(names, by_name, 1)
        top = np.argsort(-scores, axis=1, kind="stable")[:, :want]
        best[at], who[at] = np.take_along_axis(scores, top, 1), np.take_along_axis(names, top, 1)
        reach[at] = reaches(at, most, least)

    def bounds(node: tuple, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (probe[at] @ units[node[0]])))
        near = np.maximum(0.0, np.maximum(node[1] - gap, gap - node[2]))
        far = np.maximum(0.0, np.maximum(node[3] - gap, gap - node[4]))
        return near, far

    for most, least, order, nodes in bands:
        everyone = np.arange(n)
        reach[:] = reaches(everyone, most, least)
        # no direction is nearer than zero: where nothing is in reach, the band and all shorter ones hold nothing better
        everyone = everyone[best[:, k] <= most]
        if not len(everyone):
            break
        seen = np.full(n, -1)  # the leaf that a query's first descent ended in
        todo = [(0, everyone)]
        while todo:
            name, at = todo.pop()
            node = nodes[name]
            if node[0] < 0:
                visit(order[node[5] : node[6]], at, most, least)
                seen[at] = name
                continue
            near, far = bounds(node, at)
            todo += [(child, part) for child, part in ((node[6], at[far < near]), (node[5], at[far >= near])) if len(part)]
        walk = [(0, everyone, np.zeros(len(everyone)))]
        while walk:
            name, at, low = walk.pop()
            open_ = factor * low <= reach[at] * (1 + 1e-9) + 1e-7
            at, low = at[open_], low[open_]
            node = nodes[name]
            if node[0] < 0:
                at = at[seen[at] != name]
            if not len(at):
                continue
            if node[0] < 0:
                visit(order[node[5] : node[6]], at, most, least)
                continue
            near, far = bounds(node, at)
            ways = [(node[6], at, np.maximum(low, far)), (node[5], at, np.maximum(low, near))]
            walk += ways if near.sum() <= far.sum() else ways[::-1]

    out = []
    for q in range(n):
        names = who[q][who[q] < len(points)]
        found: list[tuple] = []
        for s, p in zip(_scores(points[names], queries[q]).tolist(), names.tolist()):
            own = slice(begin[p], begin[p + 1])
            found += [(-s, i, r) for i, r in zip(id_of[own][: k + 1].tolist(), row_of[own][: k + 1].tolist()) if r != rows[q]]
        out += [(rows[q], ids[q], r, i, -s) for s, i, r in sorted(found)[:k]]
    columns = list(zip(*out)) if out else [()] * 5
    return [*(np.array(c, np.int64) for c in columns[:4]), np.array(columns[4], np.float64)]


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, factor: float = FACTOR, **sizes) -> DataFrame:
    """``embeddings(vec_id, embedding)`` -> (query_id, rank, vec_id, score): each query's ``k`` largest inner products found.

    Candidates are all rows but the query's own; ties go to the smaller ``vec_id``; fewer candidates give fewer rows.
    Null ids, vectors that are null, empty, zero or hold a null or non-finite component take no part; vectors of
    other lengths are no candidates; rows that repeat are rows of their own; an empty table gives an empty result.
    Norms may differ by any factor; an inner product beyond the doubles is infinite.
    """
    rows = usable_rows(vectors, nonzero=True)
    return search_blocks(rows, is_query, build_tree, partial(search_tree, k=k, factor=factor), k, "double", **sizes)
