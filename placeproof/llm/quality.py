"""Quality score by nearest-neighbour voting in a latent-semantic space.

Terms of a text are n-grams (1 to 3) of character classes plus a few banded whole-text measures (share of distinct words, of repeated
neighbours, of upper case, word and line lengths).  Counts are damped, weighted by rarity, scaled to length one and projected on the
leading right singular vectors of a bounded labelled sample.  The labelled vectors are broadcast (`sample` x `rank` floats); each
batch of texts gets its exact cosine products with all of them, and the `k` nearest vote, weighted by similarity.
"""
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeproof.llm.base import CHUNK, give_back, pieces

CLASSES = 16
GRAMS = CLASSES + CLASSES**2 + CLASSES**3
BANDS = 12
MEASURES = 6
TERMS = GRAMS + BANDS * MEASURES
BAND_WEIGHT = 0.5


def class_table() -> np.ndarray:
    """Code point -> class: letters by case, digits, space, line end, and kinds of marks."""
    table = np.full(0x110000, 15, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = 1 if ch.isupper() else 0 if c < 128 else 2
        elif ch.isdigit():
            table[c] = 3
    for chars, kind in ((" \t", 4), ("\n\r", 5), (".", 6), (",;:", 7), ("!", 8), ("?", 9), ("'\"`", 10), ("|", 11), ("#$%&*@^~+=<>", 12), ("-_/\\", 13), ("()[]{}", 14)):
        for ch in chars:
            table[ord(ch)] = kind
    return table


def _band(x: float) -> int:
    return min(BANDS - 1, max(0, int(x * BANDS)))


def term_counts(text: str | None, table: np.ndarray) -> np.ndarray:
    """Damped counts of all terms; an empty text has only its measures."""
    text = text or ""
    grams = np.zeros(GRAMS, np.int64)
    for at in range(0, len(text), CHUNK):
        s = table[np.frombuffer(text[max(0, at - 2):at + CHUNK].encode("utf-32-le", "replace"), np.uint32)].astype(np.int64)
        two = s[:-1] * CLASSES + s[1:]
        again = min(2, at)                              # characters of the chunk before: only grams that end behind them are new
        grams += np.bincount(np.concatenate([s[again:], two[max(0, again - 1):] + CLASSES, two[:-1] * CLASSES + s[2:] + (CLASSES + CLASSES**2)]), minlength=GRAMS)
    words = text.split()
    n = len(words)
    letters = grams[0] + grams[1] + grams[2]
    measures = (len(set(words)) / n if n else 0, sum(map(eq, words, words[1:])) / n if n else 0, grams[1] / letters if letters else 0,
                letters / len(text) if text else 0, min(1.0, len(text) / n / 16) if n else 0, min(1.0, np.log1p(len(text) / (1 + grams[5])) / 10))
    out = np.zeros(TERMS, np.float32)
    out[:GRAMS] = np.log1p(grams)
    norm = float(np.sqrt((out[:GRAMS] ** 2).sum())) or 1.0
    out[:GRAMS] /= norm
    for i, x in enumerate(measures):
        out[GRAMS + i * BANDS + _band(float(x))] = BAND_WEIGHT
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 3000, rank: int = 64) -> dict:
    """Model from at most `sample` labelled documents, chosen by a hash of the id.

    Rows without id or label are left out; several labels of one id are averaged; of several texts of one id the one with the smallest
    hash is taken.  Without labels the model scores 0.5 everywhere.
    """
    spark = docs.sparkSession
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label).alias("label")).filter("id is not null and label is not null")
              .groupBy("id").agg(F.avg("label").alias("label")))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(sample)             # `sample` pairs of numbers: safe to broadcast
    table = spark.sparkContext.broadcast(class_table())

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "body"):
                v = [term_counts(t, table.value).astype(np.float16).tobytes() for t in part["body"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["id"], part["label"], pa.array(v, pa.binary())], ["id", "label", "v"])
    kind = "string" if dict(docs.dtypes)[id_col] == "string" else "long"
    labelled = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text).alias("body")).join(F.broadcast(chosen), "id")
    one = labelled.groupBy("id").agg(F.first("label").cast("double").alias("label"), F.min_by("body", F.struct(F.xxhash64("body"), "body")).alias("body"))
    got = one.mapInArrow(terms, f"id {kind}, label double, v binary").collect()      # `sample` rows at most
    got.sort(key=lambda r: (r["id"], r["v"]))
    if not got:
        return {"vectors": None}
    x = np.array([np.frombuffer(r["v"], np.float16) for r in got]).astype(np.float32)
    weight = np.log(1 + len(x) / (1 + (x > 0).sum(axis=0))).astype(np.float32)
    x *= weight
    basis = leading_directions(x, rank)
    z = x @ basis
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    return {"vectors": z, "labels": np.array([r["label"] for r in got], np.float64), "weight": weight, "basis": basis}


def leading_directions(x: np.ndarray, rank: int, rounds: int = 6) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start: two thin products a round, no square matrix."""
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ vt.T)[:, :rank])


def vote(z: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Similarity-weighted mean label of the k nearest; similarities are raised so that the closest lead."""
    cosine = z @ vectors.T
    k = min(k, len(labels))
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64) ** 8
    return np.clip((w * labels[near]).sum(axis=1) / w.sum(axis=1), 0.0, 1.0)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text", k: int = 31, out: str = "score") -> DataFrame:
    """All columns of the input plus `out` (0 to 1, null never); a column of that name is replaced.

    Row by row: repeated rows score alike, null and empty texts are scored as empty, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    cast = spark.sparkContext.broadcast(model | {"table": class_table()})
    names = [c for c in docs.columns if c != out]
    schema = docs.select(*names).schema.add(out, "double")
    text_at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, batch, part = cast.value, None, None
        for batch in batches:
            for part in pieces(batch, text):
                if m["vectors"] is None:
                    s = np.full(part.num_rows, 0.5)
                else:
                    x = np.array([term_counts(t, m["table"]) for t in part.column(text_at).to_pylist()]) * m["weight"]
                    z = x @ m["basis"]
                    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                    s = vote(z, m["vectors"], m["labels"], k)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], [*part.schema.names, out])
        del batch, part
        give_back()
    return docs.select(*names).mapInArrow(run, schema)
