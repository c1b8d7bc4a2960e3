"""Language identification by string kernels.

A text is the set of its character 1- to 3-grams (blended spectrum, presence only) over a small alphabet of lower-case letters
learned from the training texts.  The kernel of two texts is the size of the intersection over the root of the product of the set
sizes.  A bounded number of training texts are Nyström landmarks; kernel ridge regression, one language against the rest, is solved
in the landmark space, so scoring is one matrix product per batch: (texts x landmarks) times (landmarks x languages).

Bounds: `landmarks` and `training` rows, spread over the languages, are all that is gathered; every text is scored whole.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeproof.llm.base import CHUNK, pieces

SYMBOLS = 64                                            # 0: not a letter, 63: a letter outside the alphabet
CODES = SYMBOLS + SYMBOLS**2 + SYMBOLS**3


def symbol_table(counts: dict[str, int]) -> np.ndarray:
    """Code point -> symbol.  The 62 most frequent letters get their own."""
    table = np.zeros(0x110000, np.uint8)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = SYMBOLS - 1
    for i, (ch, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:SYMBOLS - 2]):
        table[ord(ch)] = i + 1
    return table


def gram_flags(text: str, table: np.ndarray, flags: np.ndarray) -> None:
    """Set the flag of each n-gram of the text; grams of non-letters alone are no features.  Long texts go by overlapping chunks."""
    text = text.lower()
    for at in range(0, max(1, len(text)), CHUNK):
        points = np.frombuffer((" " * (at == 0) + text[max(0, at - 2):at + CHUNK] + " " * (at + CHUNK >= len(text))).encode("utf-32-le", "replace"), np.uint32)
        s = table[points].astype(np.uint32)
        two = s[:-1] * SYMBOLS + s[1:]
        flags[s] = 1
        flags[two + SYMBOLS] = 1
        flags[two[:-1] * SYMBOLS + s[2:] + (SYMBOLS + SYMBOLS**2)] = 1
    flags[[0, SYMBOLS, SYMBOLS + SYMBOLS**2]] = 0


def kernel_rows(texts: list[str | None], table: np.ndarray, columns: np.ndarray, marks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kernel values against the landmarks, and which texts have a letter.  marks: (columns x landmarks) of 0 and 1."""
    seen = np.zeros((len(texts), len(columns)), np.float32)
    own = np.zeros(len(texts), np.float64)
    for i, text in enumerate(texts):
        if text:
            flags = np.zeros(CODES, np.uint8)
            gram_flags(text, table, flags)
            own[i] = flags.sum(dtype=np.int64)
            seen[i] = flags[columns]
    letters = own > 0
    return (seen @ marks) / np.sqrt(np.maximum(own, 1))[:, None] / np.sqrt(sizes)[None, :], letters


def _spread(docs: DataFrame, label: str, text: str, rows: int, salt: int) -> DataFrame:
    """About `rows` distinct labelled texts, evenly over the languages, by a hash of the text: only chosen texts are shuffled, to fold copies."""
    counts = {r[0]: r[1] for r in docs.groupBy(label).count().collect()}
    each = max(4, rows // max(1, len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))]) if counts else None
    if share is None:
        return docs.select(label, text)
    u = F.pmod(F.xxhash64(F.col(text), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    return docs.filter(u < share[F.col(label)]).select(label, text).distinct()


def fit(docs: DataFrame, label: str = "lang", text: str = "text", landmarks: int = 240, training: int = 3000, ridge: float = 1e-3) -> dict:
    """Model from rows with text and label.  Without any such row the model has no languages and predicts `und`."""
    known = docs.select(F.col(label).alias("label"), F.col(text).alias("body")).filter(F.col("label").isNotNull() & F.col("body").rlike(r"\p{L}"))
    picked = _spread(known, "label", "body", landmarks, 11).collect()
    picked.sort(key=lambda r: (r["label"], r["body"]))
    if not picked:
        return {"labels": []}
    letters: dict[str, int] = {}
    for r in picked:
        for ch in r["body"].lower():
            letters[ch] = letters.get(ch, 0) + 1
    table = symbol_table({c: n for c, n in letters.items() if c.isalpha()})
    flags = np.zeros((len(picked), CODES), np.uint8)
    for i, r in enumerate(picked):
        gram_flags(r["body"], table, flags[i])
    columns = np.flatnonzero(flags.any(axis=0))
    marks = np.ascontiguousarray(flags[:, columns].T.astype(np.float32))
    sizes = flags.sum(axis=1, dtype=np.int64).astype(np.float64)
    model = {"table": table, "columns": columns, "marks": marks, "sizes": sizes, "labels": []}
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        for batch in batches:
            for part in pieces(batch, "body"):
                k, _ = kernel_rows(part["body"].to_pylist(), m["table"], m["columns"], m["marks"], m["sizes"])
                yield pa.RecordBatch.from_arrays([part["label"], pa.array(list(k.astype(np.float64)), pa.list_(pa.float64()))], ["label", "k"])
    got = _spread(known, "label", "body", training, 12).mapInArrow(rows, "label string, k array<double>").collect()
    cast.unpersist()
    got.sort(key=lambda r: (r["label"], r["k"]))
    if not got:
        return {"labels": []}
    labels = sorted({r["label"] for r in got})
    k_nm = np.array([r["k"] for r in got])
    y = np.where(np.array([r["label"] for r in got])[:, None] == np.array(labels)[None, :], 1.0, -1.0)
    inner = marks.T.astype(np.float64) @ marks / np.sqrt(sizes[:, None] * sizes[None, :])
    value, vector = np.linalg.eigh(inner)
    keep = value > 1e-8 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = np.hstack([k_nm @ root, np.ones((len(got), 1))])
    weight = np.linalg.solve(phi.T @ phi + ridge * len(got) * np.eye(phi.shape[1]), phi.T @ y)
    return model | {"labels": labels, "weight": root @ weight[:-1], "bias": weight[-1]}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row.

    Null and empty texts, texts without a letter and an untrained model give `und` with score 0.  Equal texts get equal results, ties
    go to the smaller label, repeated ids keep their rows.  score is the winner's regression value mapped from (-1, 1) to (0, 1).
    """
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        for batch in batches:
            for part in pieces(batch, "body"):
                if m["labels"]:
                    k, letters = kernel_rows(part["body"].to_pylist(), m["table"], m["columns"], m["marks"], m["sizes"])
                    s = k @ m["weight"] + m["bias"]
                    best = s.argmax(axis=1)
                    name = [m["labels"][b] if ok else "und" for b, ok in zip(best, letters)]
                    value = np.where(letters, np.clip((s[np.arange(len(s)), best] + 1) / 2, 0, 1), 0.0)
                else:
                    name, value = ["und"] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(name, pa.string()), pa.array(value)], ["id", "lang_pred", "score"])
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text).alias("body"))
            .mapInArrow(score, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col))
