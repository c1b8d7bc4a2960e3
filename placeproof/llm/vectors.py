"""Vectors in blocks: both vector searches meet blocks of queries with blocks of candidates.

A block is one row holding the ids and a matrix of a bounded number of vectors.  Query blocks are copied to `lanes` lanes and each
candidate block goes to one lane per query block, so the equi-join on (query block, lane) spreads over the cluster, and a task holds
two blocks at a time.  Equal vectors in any number are ordinary rows here: blocks are cut by a hash of the id.
"""
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeproof.llm.base import blocks_of

QUERY_ROWS, CANDIDATE_ROWS = 512, 4096


def usable(vector: str) -> Column:
    """Not null and without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def blocks(rows: DataFrame, count: int, size: int) -> DataFrame:
    """(block, ids, flat vectors) of rows (id long, v array<double>), repeated rows once; count: number of rows."""
    n = blocks_of(count, size)
    return (rows.groupBy(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n)).alias("block"), F.size("v").alias("dim"))
            .agg(F.sort_array(F.collect_set(F.struct("id", "v"))).alias("r")).select("block", "dim", F.col("r.id").alias("ids"), F.flatten("r.v").alias("v")))


def search(queries: DataFrame, candidates: DataFrame, k: int, local: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]],
           largest: bool, kind: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best over all blocks, ties to the smaller id.

    local(query ids, query matrix, candidate ids, candidate matrix) gives (query id, ids, scores) with at most about k per query.
    Vectors of different lengths never meet.
    """
    nq, nc = queries.count(), candidates.count()
    lanes = blocks_of(nc, CANDIDATE_ROWS)
    count = blocks_of(nq, QUERY_ROWS)
    left = blocks(queries, nq, QUERY_ROWS).select(F.col("block").alias("qb"), "dim", F.col("ids").alias("q_ids"), F.col("v").alias("q_v"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    right = blocks(candidates, nc, CANDIDATE_ROWS).select(F.col("block").cast("int").alias("lane"), "dim", "ids", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("qb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_v, ids, v, dim = (batch.column(j)[i].values.to_numpy(zero_copy_only=False) if j < 4 else batch.column(j)[i].as_py() for j in range(5))
                found = list(local(q_ids, q_v.reshape(-1, dim), ids, v.reshape(-1, dim)))
                size = [len(x[1]) for x in found]
                if sum(size):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in found], size)), pa.array(np.concatenate([x[1] for x in found])),
                                                      pa.array(np.concatenate([x[2] for x in found]))], ["query_id", "vec_id", "score"])
    met = left.join(right.hint("shuffle_hash"), ["qb", "lane", "dim"]).select("q_ids", "q_v", "ids", "v", "dim").mapInArrow(run, f"query_id long, vec_id long, score {kind}")
    order = W.partitionBy("query_id").orderBy(F.desc("score") if largest else F.asc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
