"""Approximate nearest neighbours by collision counting over sorted projections.

Each of `projections` random directions orders the vectors of a block.  A query opens a window of half the bucket width around its own
projection in every order; virtual rehashing widens all windows by the ratio and only the newly covered stretches are counted.  A
vector covered by enough windows (the collision threshold) is verified with its exact distance.  A block is done when k verified
vectors lie within a `margin` of the half window, or when half of it is verified, or when all windows cover it.
All vectors are indexed, and each block answers for its own rows, so the merged answer is at least as good as the worst block.
"""
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeproof.llm.vectors import search, usable


def in_block(k: int, projections: int, start: float, ratio: float, margin: float, threshold: float, extra: int, seed: int):
    """Search of one pair of blocks; start: the first half window, in median deviations of the block's projections."""
    def local(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        n, a = len(v), np.random.default_rng(seed).standard_normal((v.shape[1], projections))
        key = (v @ a).T
        order = np.argsort(key, axis=1, kind="stable").ravel()
        spread = float(np.median(np.abs(key - np.median(key, axis=1, keepdims=True)))) or 1.0
        # One ascending array for all projections: each is shifted to its own stretch.
        reach = float(np.abs(key).max()) + float(np.abs(q @ a).max(initial=0)) + 1.0
        shift = np.arange(projections) * 8 * reach
        sort = (np.sort(key, axis=1) + shift[:, None]).ravel()
        floor, top = np.arange(projections) * n, (np.arange(projections) + 1) * n
        need = max(1, int(np.ceil(threshold * projections)))
        for own, x in zip(q_ids, q):
            at = x @ a + shift
            lo = np.searchsorted(sort, at)
            hi = lo.copy()
            hits = np.zeros(n, np.int64)
            done = np.zeros(n, bool)
            near_d, near_i = np.zeros(0), np.zeros(0, np.int64)
            radius = start * spread
            while True:
                wide = min(radius, 3 * reach)
                new_lo = np.maximum(np.searchsorted(sort, at - wide, "left"), floor)
                new_hi = np.minimum(np.searchsorted(sort, at + wide, "right"), top)
                fresh = np.concatenate([order[b:e] for b, e in zip(np.concatenate([new_lo, hi]), np.concatenate([lo, new_hi]))])
                lo, hi = new_lo, new_hi
                hits += np.bincount(fresh, minlength=n)
                some = np.flatnonzero((hits >= need) & ~done)
                done[some] = True
                some = some[ids[some] != own]
                if len(some):
                    near_d = np.concatenate([near_d, np.sqrt(((v[some] - x) ** 2).sum(axis=1))])
                    near_i = np.concatenate([near_i, ids[some]])
                if wide < radius or len(near_d) >= k + extra and (2 * len(near_d) >= n or np.partition(near_d, k - 1)[k - 1] <= margin * radius):
                    break
                radius *= ratio
            first = np.lexsort((near_i, near_d))[:k]
            yield int(own), near_i[first], near_d[first]
    return local


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", projections: int = 64, start: float = 0.8,
            ratio: float = 1.25, margin: float = 1.0, threshold: float = 0.6, extra: int = 100, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, score the exact Euclidean distance of the originals.

    Ties go to the smaller id; with fewer than k candidates all are returned; rows with null ids, null, empty, zero or non-finite
    vectors take no part; vectors of another length are never compared; equal vectors are separate candidates; ids are unique.
    """
    def clean(df: DataFrame) -> DataFrame:
        return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & usable("v") & F.exists("v", lambda x: x != 0))
                .select("id", F.transform("v", lambda x: x.cast("double")).alias("v")))
    return search(clean(queries), clean(vectors), k, in_block(k, projections, start, ratio, margin, threshold, extra, seed), False, "double")
