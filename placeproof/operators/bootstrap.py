"""Grouped bootstrap: whole groups are redrawn, in one pass over per-group sums."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPS = 10_000
CHUNK = 500
#: P(X <= k) of Poisson(1), k = 0 ... 12.
CUMULATIVE = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 13.0)])))


def draws(keys: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) multiplicities, (groups x replicates).

    Each number is a hash of the group's key and the replicate's number, so the result depends on
    neither the partitioning nor the order, and all groups of a batch are drawn at once.
    """
    def mix(h):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))
    salt = mix((reps.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.array([seed], np.uint64))
    u = (mix(keys.astype(np.int64).view(np.uint64)[:, None] ^ salt[None, :]) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(CUMULATIVE, u, side="right").astype(np.float64)


VECTORS = "chunk long, cell long, w array<double>"


def summed(batches):
    """Sums of the vectors of each (chunk, cell) of a stream in that order, one vector in memory at a time."""
    key, total, out = None, None, []

    def rows():
        return pd.DataFrame({"chunk": [k[0] for k, _ in out], "cell": [k[1] for k, _ in out], "w": [w.tolist() for _, w in out]})
    for pdf in batches:
        for chunk, cell, w in zip(pdf["chunk"], pdf["cell"], pdf["w"]):
            if key == (chunk, cell):
                total = total + w
                continue
            if key is not None:
                out.append((key, total))
            key, total = (chunk, cell), np.asarray(w, float)
            if len(out) == 256:
                yield rows()
                out = []
    if key is not None:
        out.append((key, total))
        yield rows()


def _bounds(boots: DataFrame, level: float) -> DataFrame:
    tail = (1 - level) / 2
    return boots.agg(F.round(F.percentile("m", tail), 4).alias("lo"), F.round(F.percentile("m", 1 - tail), 4).alias("hi"), F.count("*").alias("resamples"))


def grouped_mean_ci(df: DataFrame, value: str, group: str, reps: int = REPS, level: float = 0.95, seed: int = 7) -> DataFrame:
    """One row: point, n, n_groups, lo, hi, resamples.  Tasks fold their groups into one vector per replicate
    before the shuffle, so the shuffle carries (tasks x replicates) numbers, not groups x replicates."""
    per = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("c")).select(
        F.xxhash64(F.col(group).cast("string")).alias("k"), F.col("s").cast("double").alias("s"), F.col("c").cast("double").alias("c"))

    def fold(batches):
        num, den = np.zeros(reps), np.zeros(reps)
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                w = draws(pdf["k"].to_numpy()[at:at + 256], np.arange(reps), seed)
                num += np.nan_to_num(pdf["s"].to_numpy()[at:at + 256]) @ w
                den += pdf["c"].to_numpy()[at:at + 256] @ w
        yield pd.DataFrame({"rep": np.arange(reps), "num": num, "den": den})

    boots = (per.mapInPandas(fold, "rep long, num double, den double").groupBy("rep")
             .agg((F.sum("num") / F.greatest(F.sum("den"), F.lit(1.0))).alias("m")))
    pt = df.agg(F.round(F.avg(value), 4).alias("point"), F.count(value).alias("n"))
    g = per.agg(F.count("*").alias("n_groups"))
    return pt.crossJoin(g).crossJoin(_bounds(boots, level))          # three one-row tables


def grouped_median_ci(df: DataFrame, value: str, group: str, reps: int = REPS, cells: int = 1000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """One row: point, n, n_groups, lo, hi, resamples of the median.

    A replicate's median is read off weighted counts per quantile cell (a bound is exact to one cell, 1/cells of the
    rows; with fewer distinct values than cells it is exact).  Replicates are handled in chunks.  The vectors of all tasks
    for one (chunk, cell) are summed as a stream, so a group of the last step holds `cells` rows of one chunk whatever the tasks.
    """
    ps = [(i + 0.5) / cells for i in range(cells)]
    edges = df.agg(F.percentile_approx(value, F.array(*[F.lit(p) for p in ps]), 100_000).alias("e"))
    cell = (df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).select(                      # one row
        F.xxhash64(F.col(group).cast("string")).alias("k"), F.col(value).cast("double").alias("v"), "e")
        .groupBy("k", F.least(F.size(F.filter("e", lambda x: x < F.col("v"))), F.size("e") - 1).alias("cell")).agg(F.count("*").cast("double").alias("c")))
    chunks = range(0, reps, CHUNK)

    def fold(batches):
        acc = np.zeros((cells, reps))
        used = np.zeros(cells, bool)
        for pdf in batches:
            at, c, k = (pdf[x].to_numpy() for x in ("cell", "c", "k"))
            for lo in range(0, len(pdf), 256):
                np.add.at(acc, at[lo:lo + 256], draws(k[lo:lo + 256], np.arange(reps), seed) * c[lo:lo + 256, None])
            used[at] = True
        for i in np.flatnonzero(used):
            yield pd.DataFrame({"chunk": list(chunks), "cell": int(i), "w": [acc[i, lo:lo + CHUNK].tolist() for lo in chunks]})

    def medians(pdf):
        total = np.zeros((cells, len(pdf["w"].iloc[0])))
        for i, w in zip(pdf["cell"], pdf["w"]):
            total[int(i)] += w
        upto = total.cumsum(axis=0)
        return pd.DataFrame({"cell": (upto * 2 < upto[-1]).sum(axis=0).clip(0, cells - 1)})
    folded = cell.mapInPandas(fold, VECTORS).repartition("chunk", "cell").sortWithinPartitions("chunk", "cell")
    found = folded.mapInPandas(summed, VECTORS).groupBy("chunk").applyInPandas(medians, "cell long")
    boots = found.crossJoin(F.broadcast(edges)).select(F.element_at("e", F.col("cell").cast("int") + 1).cast("double").alias("m"))
    pt = df.agg(F.round(F.percentile(value, 0.5), 4).alias("point"), F.count(value).alias("n"), F.count_distinct(group).alias("n_groups"))
    return pt.crossJoin(_bounds(boots, level))                       # two one-row tables
