"""Exact top-k by inner product of quantised vectors: columnar branch-and-bound.

A shard keeps its vectors in vertical layout: one contiguous column per dimension, dimensions of large mass first, and
for each block of dimensions the norm that is left behind it.  A query adds up products block by block.  After each
block, Cauchy-Schwarz on the remaining norms bounds every candidate's score from both sides; candidates whose upper
bound is below the k-th best lower bound are compacted away before the next block.
"""

from __future__ import annotations

import pickle
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame

from flowlens.llm.vectors import search_blocks, usable_rows

SCALE = 1024
NEIGHBOURS = 10
BLOCK_DIMENSIONS = 8
#: Integers up to here add and multiply exactly in doubles.
EXACT = 1 << 53


def quantised(matrix: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(scale * matrix)


def build_columns(rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray, scale: int, width: int = BLOCK_DIMENSIONS) -> bytes:
    """Serialise one shard's vertical layout."""
    values = quantised(matrix, scale)
    mass = np.einsum("ij,ij->j", values, values)
    dims = np.argsort(-mass, kind="stable")
    columns = np.ascontiguousarray(values[:, dims].T)
    return pickle.dumps((rows.copy(), ids.copy(), dims, columns, _left(columns, width)), protocol=5)


def _left(columns: np.ndarray, width: int) -> np.ndarray:
    """Norm of each vector's dimensions behind each block."""
    starts = range(width, len(columns) + width, width)
    return np.stack([np.sqrt(np.einsum("ij,ij->j", columns[s:], columns[s:])) for s in starts])


def search_columns(index: bytes, rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int, scale: int, width: int = BLOCK_DIMENSIONS):
    """Exact hits of a block of queries in one shard."""
    row_of, id_of, dims, columns, left = pickle.loads(index)
    queries = quantised(matrix, scale)[:, dims]
    query_left = _left(np.ascontiguousarray(queries.T), width)
    out: list[tuple] = []
    peak = np.abs(columns).max(initial=0.0) * len(dims)
    for q in range(len(queries)):
        alive = np.flatnonzero(row_of != rows[q])
        if peak * np.abs(queries[q]).max(initial=0.0) > EXACT:
            score = _exact(columns[:, alive], queries[q])
        else:
            alive, score = _bounded(columns, left, queries[q], query_left[:, q], alive, k, width)
            score = score.astype(np.int64).tolist()
        top = sorted(zip((-s for s in score), id_of[alive].tolist(), row_of[alive].tolist()))[:k]
        out += [(rows[q], ids[q], r, i, -s) for s, i, r in top]
    found = list(zip(*out)) if out else [()] * 5
    return [np.array(c, np.int64) for c in found]


def _bounded(columns, left, query, query_left, alive, k, width):
    score = np.zeros(len(alive))
    for b, start in enumerate(range(0, len(query), width)):
        block = columns[start : start + width]
        score += query[start : start + width] @ (block if len(alive) == columns.shape[1] else block[:, alive])
        if len(alive) <= k:
            continue
        slack = left[b][alive] * query_left[b] * (1 + 1e-12)
        floor = score - slack
        keep = score + slack >= np.partition(floor, len(floor) - k)[len(floor) - k]
        if not keep.all():
            alive, score = alive[keep], score[keep]
    return alive, score


def _exact(columns, query) -> list[int]:
    """Whole-number scores where doubles would round."""
    total = [0] * columns.shape[1]
    for column, c in zip(columns, query):
        total = [t + int(c) * int(x) for t, x in zip(total, column)]
    return total


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, scale: int = SCALE, **sizes) -> DataFrame:
    """``embeddings(vec_id, embedding)`` -> (query_id, rank, vec_id, score), exact.

    Components become floor(scale * x), x as double; the score is the integer inner product.  Candidates are all
    rows but the query's own; ties go to the smaller ``vec_id``; fewer candidates give fewer rows.  Null ids, vectors
    that are null, empty or hold a null or non-finite component take no part; vectors of other lengths are no
    candidates; rows that repeat are rows of their own; scores beyond a long raise an error; an empty table gives an
    empty result.
    """
    rows = usable_rows(vectors, nonzero=False)
    return search_blocks(rows, is_query, partial(build_columns, scale=scale), partial(search_columns, k=k, scale=scale), k, "long", **sizes)
