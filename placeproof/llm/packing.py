"""Packing by optimal length buckets.

A dynamic program over the global length histogram picks the bucket boundaries with the least padding; batches of at most `budget`
padded tokens form inside each bucket.  The histogram is exact up to 2,048 tokens and has 1,024 bins per doubling above, so its size
is bounded whatever the corpus.  Buckets are cut by hash into shards of a bounded number of rows; numbering runs inside a shard.
"""
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeproof.llm.base import stage, word_count

EXACT = 2048


def bin_top(n: Column) -> Column:
    """Upper end of the bin of a length."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(n)) - 10).cast("long")
    return F.when(n <= EXACT, n).otherwise((F.ceil(n / step) * step).cast("long"))


def boundaries(top: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Tops of the buckets that minimise the sum of (top - length); ascending lengths in, at most `buckets` boundaries out."""
    n = len(top)
    if n == 0:
        return []
    upto = np.concatenate([[0], np.cumsum(count)]).astype(np.float64)
    best = top * upto[1:]                               # padded tokens of the first j + 1 bins in one bucket
    back = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        last = np.concatenate([[0.0], best])            # last[i]: the first i bins
        new, cut = np.empty(n), np.empty(n, np.int64)
        for j in range(n):
            padded = last[:j + 1] + top[j] * (upto[j + 1] - upto[:j + 1])
            cut[j] = padded.argmin()
            new[j] = padded[cut[j]]
        best = new
        back.append(cut)
    found, j = [], n
    for cut in reversed(back):
        if j == 0:
            break
        found.append(int(top[j - 1]))
        j = int(cut[j - 1])
    return found[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: Column | None = None, buckets: int = 16, budget: int = 65_536,
         shard_rows: int = 16_384) -> DataFrame:
    """(id, n_tokens, bucket, boundary, batch_id, batch_row, batch_rows, padding) of every row.

    Length is the word count unless a column is given.  Rows without tokens are in no bucket (nulls).  A document longer than the
    budget is a batch of its own.  Repeated rows are packed each; null ids like any other; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    lengths = stage(docs.select(F.col(id_col).alias("id"), (length.cast("long") if length is not None else word_count(F.col(text))).alias("n"),
                                F.xxhash64(id_col, text).alias("h")), "pack-lengths")
    hist = lengths.filter("n > 0").groupBy(bin_top(F.col("n")).alias("top")).agg(F.count("*").alias("c")).orderBy("top").collect()
    top, count = np.array([r["top"] for r in hist], np.float64), np.array([r["c"] for r in hist], np.float64)
    ends = boundaries(top, count, buckets)
    rows, at = [], 0
    for b, end in enumerate(ends):
        n = int(count[(top > at) & (top <= end)].sum())
        per = max(1, budget // end)
        rows.append((b, at, end, per, max(1, -(-n // (per * max(1, shard_rows // per))))))
        at = end
    level = F.lit(0)
    for b, lo, _, _, _ in rows:
        level = F.when(F.col("n") > lo, F.lit(b)).otherwise(level) if b else level
    pick = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in rows] or [F.lit(0)]), F.col("bucket") + 1).cast("long")
    placed = (lengths.withColumn("bucket", F.when(F.col("n") > 0, level).cast("int")).withColumn("boundary", pick(2)).withColumn("per", pick(3))
              .withColumn("shard", F.coalesce(F.pmod("h", pick(4)), F.pmod("h", F.lit(4096)))))
    key = W.partitionBy("bucket", "shard")
    place = (F.row_number().over(key.orderBy("n", "id", "h")) - 1).cast("long")
    shown = placed.withColumn("place", place).withColumn("members", F.count("*").over(key))
    batch = F.floor(F.col("place") / F.col("per"))
    full = F.col("bucket").isNotNull()
    return shown.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), "bucket", "boundary",
                        F.when(full, F.concat_ws("-", "bucket", "shard", batch)).alias("batch_id"), F.when(full, F.col("place") % F.col("per")).alias("batch_row"),
                        F.when(full, F.least("per", F.col("members") - batch * F.col("per"))).alias("batch_rows"),
                        F.when(full, F.col("boundary") - F.col("n")).alias("padding"))
