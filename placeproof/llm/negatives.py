"""Hard-negative mining by threshold joins in the manner of L2AP.

For an anchor and each of its best rows of the same label (positives) the best rows of other labels are sought whose score lies between a
share of the positive's score and that score.  Scores are inner products of integer vectors.

Candidates are cut into blocks; every block is one lane.  A lane's stream holds its candidate block and then all anchor blocks (secondary
sort by lane and kind), so a candidate block is shipped and indexed once and only anchors are copied.  In a lane:

* dimensions are taken in the order of their weight in the block, in chunks, and the norm of what is left of each vector is known after
  every chunk.  For a threshold t a chunk is indexed for a candidate only as long as the norms left of it and of some open anchor could
  still reach t: the rest is covered by the bound and stays out of the index;
* partial scores are accumulated over the chunks, and a candidate that cannot reach t for any open anchor with the norms left is passed over;
* rows whose partial score and bound reach t are scored in whole;
* an anchor whose windows are not yet full gets a lower threshold; chunks that were left out are then added, nothing is summed twice.  It
  ends at the foot of its windows (none for positives, which may end with all rows).

A lane gives at most k rows for each anchor and window, and the best over all lanes are the result: exact, whatever the blocks.
Arithmetic is exact in doubles as long as squared norms stay below 2^53; larger vectors are refused.
"""
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeproof.llm.base import blocks_of, stage
from placeproof.llm.vectors import usable

BLOCK_ROWS, ANCHOR_ROWS = 2048, 256
CHUNK = 8                                               # dimensions of a chunk
START, LOWER, STEPS = 0.5, 0.6, 5                       # first threshold as a share of the largest possible score, factor of each next one


class Index:
    """Candidates of one block with the norms left after each chunk."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.order = ids, np.argsort(-(v * v).sum(axis=0), kind="stable")
        self.v = v[:, self.order]
        self.chunks = max(1, -(-v.shape[1] // CHUNK))
        self.rest = self.left(self.v)

    def left(self, v: np.ndarray) -> np.ndarray:
        """Norm of the dimensions from each chunk on (0 behind the last)."""
        square = np.add.reduceat(v * v, np.arange(0, v.shape[1], CHUNK), axis=1)
        return np.sqrt(np.concatenate([square[:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros((len(v), 1))], axis=1))

    def search(self, q: np.ndarray, first: np.ndarray, lower: Callable[[int, float], float], full: Callable[[int, np.ndarray, np.ndarray, float], bool]) -> None:
        """Threshold joins for the anchors q: full(anchor, rows, scores, t) is told all rows of score t or more and says whether that is enough;
        if not, the threshold falls to lower(anchor, t), until that is no longer lower."""
        q = q[:, self.order]
        left, t, slack = self.left(q), first.astype(float), 1e-9
        partial = np.zeros((len(self.v), len(q)))
        depth = np.zeros(len(self.v), np.int64)         # chunks summed so far
        open_ = np.arange(len(q))
        while len(open_):
            reach = t[open_] - slack * (1 + np.abs(t[open_]))
            for c in range(self.chunks):
                # a bound that no open anchor reaches leaves the chunk out of the index; at thresholds of 0 or less nothing is covered
                ratio = np.where(reach > 0, left[open_, c] / np.maximum(reach, 1e-300), np.inf).max()
                rows = np.flatnonzero((depth == c) & (self.rest[:, c] * min(ratio, 1e300) >= 1 if np.isfinite(ratio) else depth == c))
                if not len(rows):
                    continue
                alive = (partial[np.ix_(rows, open_)] + self.rest[rows, c, None] * left[None, open_, c] >= reach).any(axis=1)
                rows = rows[alive]
                a, b = c * CHUNK, (c + 1) * CHUNK
                partial[rows] += self.v[rows, a:b] @ q[:, a:b].T
                depth[rows] = c + 1
            bound = partial[:, open_] + self.rest[np.arange(len(depth)), depth][:, None] * left[open_][:, depth].T
            still = []
            for i, a in enumerate(open_):
                rows = np.flatnonzero(bound[:, i] >= reach[i])
                scores = self.v[rows] @ q[a]
                hit = scores >= t[a]
                if full(int(a), rows[hit], scores[hit], float(t[a])):
                    continue
                below = lower(int(a), float(t[a]))
                if below < t[a]:
                    t[a] = below
                    still.append(a)
            open_ = np.array(still, np.int64)


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return rows[np.lexsort((ids[rows], -scores))[:k]]


def best_of_label(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, a: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, 0, ids, scores) of the k best candidates of the anchor's label in a block, itself excluded."""
    for label in np.unique(a_labels):
        mine, those = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
        if not len(those):
            continue
        index, q = Index(ids[those], v[those]), a[mine]
        top = np.sqrt((q * q).sum(axis=1)) * index.rest[:, 0].max()
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def full(i: int, rows: np.ndarray, scores: np.ndarray, t: float) -> bool:
            other = index.ids[rows] != a_ids[mine[i]]
            found[i] = rows[other], scores[other]
            return len(found[i][0]) >= k or len(rows) == len(index.ids)

        def lower(i: int, t: float) -> float:
            return t * LOWER if t > top[i] * START * LOWER**STEPS and t > 0 else -np.inf
        index.search(q, top * START, lower, full)
        for i, (rows, scores) in found.items():
            order = np.lexsort((index.ids[rows], -scores))[:k]
            yield int(mine[i]), 0, index.ids[rows[order]], scores[order]


def below_positives(index: Index, labels: np.ndarray, a_labels: np.ndarray, a: np.ndarray, p: np.ndarray, k: int, num: int, den: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, window, ids, scores): the k best rows of another label in each window num * p <= den * score <= den * p of an anchor.

    p has a row of window tops for each anchor; the lowest integer stands for no window."""
    none = np.iinfo(np.int64).min
    foot = np.where(p == none, np.inf, -np.floor_divide(-num * np.where(p == none, 0, p), den)).astype(float)
    top = np.where(p == none, -np.inf, p.astype(float))
    foot = np.where(foot > top, np.inf, foot)           # below 0 a window is empty
    floor = foot.min(axis=1, initial=np.inf)
    use = np.flatnonzero(np.isfinite(floor))
    if not len(use):
        return
    high = np.where(np.isfinite(foot), top, -np.inf).max(axis=1, initial=-np.inf)
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    step = np.maximum((high - floor) / 4, 1)

    def full(i: int, rows: np.ndarray, scores: np.ndarray, t: float) -> bool:
        j = use[i]
        other = labels[rows] != a_labels[j]
        rows, scores = found[i] = rows[other], scores[other]
        return all(t <= f or ((scores >= f) & (scores <= h)).sum() >= k for f, h in zip(foot[j], top[j]) if np.isfinite(f))

    def lower(i: int, t: float) -> float:
        return max(floor[use[i]], t - step[use[i]])
    index.search(a[use], np.maximum(high[use] - step[use], floor[use]), lower, full)
    for i, (rows, scores) in found.items():
        for w, (f, h) in enumerate(zip(foot[use[i]], top[use[i]])):
            inside = np.flatnonzero((scores >= f) & (scores <= h)) if np.isfinite(f) else np.zeros(0, np.int64)
            order = inside[np.lexsort((index.ids[rows[inside]], -scores[inside]))[:k]]
            if len(order):
                yield int(use[i]), w, index.ids[rows[order]], scores[order]


def labelled(vectors: DataFrame, id_col: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, v): each component as floor(scale * x) in double precision; rows with a null id or label or an unusable vector leave."""
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v"))
            .select("id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")))


def _blocks(rows: DataFrame, size: int, count: int, extra: str = "array()") -> DataFrame:
    """(block, dim, ids, labels, v, p) of rows, repeated rows once."""
    n = blocks_of(count, size)
    return (rows.groupBy(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n)).alias("block"), F.size("v").alias("dim"))
            .agg(F.sort_array(F.collect_set(F.struct("id", "label", "v", F.expr(f"cast({extra} as array<long>)").alias("p")))).alias("r"))
            .select("block", "dim", F.col("r.id").alias("ids"), F.col("r.label").alias("labels"), F.flatten("r.v").alias("v"), F.flatten("r.p").alias("p")))


def _meet(candidates: DataFrame, anchors: DataFrame, lanes: int, local, k: int) -> DataFrame:
    """(anchor_id, slot, vec_id, score): the k best of each (anchor, slot) over all lanes.

    local(candidate ids, labels, matrix) gives a function of (anchor ids, labels, matrix, p) that yields (anchor row, slot, ids, scores)."""
    copied = anchors.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("kind", F.lit(1))
    own = candidates.withColumn("lane", F.col("block").cast("int")).withColumn("kind", F.lit(0))
    stream = own.unionByName(copied).repartition("lane", "dim").sortWithinPartitions("lane", "dim", "kind", "block").select("lane", "dim", "kind", "ids", "labels", "v", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, search = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                lane, dim, kind = (batch.column(c)[i].as_py() for c in range(3))
                ids, labels, v, p = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(3, 7))
                if kind == 0:
                    held, search = (lane, dim), local(ids, labels, v.reshape(-1, dim))
                    continue
                if held != (lane, dim):                 # no candidate of this length in the lane
                    continue
                found = list(search(ids, labels, v.reshape(-1, dim), p.reshape(len(ids), -1) if len(p) else np.zeros((len(ids), 0), np.int64)))
                size = [len(x[2]) for x in found]
                if sum(size):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[[x[0] for x in found]], size)), pa.array(np.repeat([x[1] for x in found], size).astype(np.int32)),
                                                      pa.array(np.concatenate([x[2] for x in found])), pa.array(np.concatenate([x[3] for x in found]).astype(np.int64))], ["anchor_id", "slot", "vec_id", "score"])
    met = stream.mapInArrow(run, "anchor_id long, slot int, vec_id long, score long")
    order = W.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, num: int = 80, den: int = 100, scale: int = 256,
                   id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    positives: the first rows of the anchor's label, by score and then smaller id; negatives: the first rows of another label with
    num * positive_score <= den * negative_score <= den * positive_score, for each positive.  With fewer, all are given; an anchor without
    positives, or a positive without negatives, has no row.  Rows with a null id or label or a null, empty or non-finite vector take no part;
    vectors of different lengths never meet; repeated rows count once; ids are otherwise taken to be unique.  Raises ValueError where a
    squared norm reaches 2^53.
    """
    rows = stage(labelled(vectors, id_col, vector, label, scale), "negatives-rows")
    asked = labelled(anchors, id_col, vector, label, scale)
    n, norm = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    if norm is not None and norm >= 1 << 53:
        raise ValueError("components are too large for exact scores")
    lanes, m = blocks_of(n, BLOCK_ROWS), asked.count()
    candidates = stage(_blocks(rows, BLOCK_ROWS, n), "negatives-blocks")

    def same(ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        return lambda a_ids, a_labels, a, p: best_of_label(ids, labels, v, a_ids, a_labels, a, positives)

    def other(ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        index = Index(ids, v)
        return lambda a_ids, a_labels, a, p: below_positives(index, labels, a_labels, a, p, negatives, num, den)
    chosen = stage(_meet(candidates, _blocks(asked, ANCHOR_ROWS, m), lanes, same, positives), "negatives-positives")
    tops = chosen.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("at"))
    windows = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.col("at")[i], F.lit(np.iinfo(np.int64).min)))
    with_tops = asked.join(tops, asked["id"] == tops["anchor_id"]).select("id", "label", "v", windows.alias("tops"))
    hard = _meet(candidates, _blocks(with_tops, ANCHOR_ROWS, m, "tops"), lanes, other, negatives)
    named = chosen.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(named, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
