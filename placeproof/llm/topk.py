"""Exact top-k by inner product with pivot-table elimination.

One more component makes all candidates equally long (its square is the missing part of the largest squared norm); then the largest
inner product is the smallest Euclidean distance and the triangle inequality holds.  The distances of all candidates to `pivots`
reference vectors are computed once per block; for a query the largest difference to its own pivot distances is a lower bound of its
distance.  Candidates are evaluated in the order of the bound until the bound passes the k-th best distance so far: nothing after that
can be among the k.  Scores are exact integers; bounds carry a slack far above the rounding of doubles.
"""
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeproof.llm.vectors import search, usable

STEP = 64


def quantise(vectors: DataFrame, id_col: str, vector: str, scale: int = 1024) -> DataFrame:
    """(id, v): each component as floor(scale * x) in double precision; unusable vectors and null ids leave."""
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & usable("v"))
            .select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")))


def in_block(k: int, pivots: np.ndarray, top: float):
    """Search of one pair of blocks; top: the largest squared norm of all candidates."""
    def local(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        p = pivots[:, :v.shape[1]] if len(pivots) and pivots.shape[1] == v.shape[1] + 1 else np.zeros((0, v.shape[1]))
        rest = np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))
        p_rest = pivots[:len(p), -1] if len(p) else np.zeros(0)
        p_norm = (p * p).sum(axis=1) + p_rest**2
        table = np.sqrt(np.maximum(top + p_norm[None, :] - 2 * (v @ p.T + rest[:, None] * p_rest[None, :]), 0))
        q_norm = (q * q).sum(axis=1)
        q_table = np.sqrt(np.maximum(q_norm[:, None] + p_norm[None, :] - 2 * (q @ p.T), 0))
        slack = 1e-6 * (1 + np.sqrt(top + q_norm.max(initial=0)))
        for i, own in enumerate(q_ids):
            bound = np.abs(table - q_table[i]).max(axis=1, initial=0)
            order = np.argsort(bound, kind="stable")
            best_s, best_i = np.zeros(0, np.float64), np.zeros(0, np.int64)
            for at in range(0, len(order), STEP):
                if len(best_s) == k and bound[order[at]] > np.sqrt(max(0.0, top + q_norm[i] - 2 * best_s[-1])) + slack:
                    break
                some = order[at:at + STEP]
                some = some[ids[some] != own]
                s, n = np.concatenate([best_s, v[some] @ q[i]]), np.concatenate([best_i, ids[some]])
                first = np.lexsort((n, -s))[:k]
                best_s, best_i = s[first], n[first]
            yield int(own), best_i, best_s.astype(np.int64)
    return local


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", pivots: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k candidates of the largest integer inner product, itself excluded.

    Ties go to the smaller id; with fewer candidates all are returned; rows with null ids, null, empty or non-finite vectors take no
    part; vectors of another length are never compared; equal vectors are separate candidates; ids are taken to be unique.
    """
    rows, asked = quantise(vectors, id_col, vector), quantise(queries, id_col, vector)
    chosen = [r["v"] for r in rows.orderBy(F.xxhash64("id", F.lit(29)), "id").limit(pivots).collect()]
    top = rows.select(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("n")).agg(F.max("n")).first()[0] or 0.0
    dim = len(chosen[0]) if chosen else 0
    table = np.array([r for r in chosen if len(r) == dim]).reshape(-1, dim) if chosen else np.zeros((0, 0))
    table = np.hstack([table, np.sqrt(np.maximum(top - (table * table).sum(axis=1, keepdims=True), 0))]) if len(table) else table
    return search(asked, rows, k, in_block(k, table, float(top)), True, "long")
