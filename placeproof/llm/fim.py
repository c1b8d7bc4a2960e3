"""Fill-in-the-middle transformation by secondary sort.

A text is cut into units: a word with the white space before it, or white space at the end.  Two boundaries and a form are drawn from the
SHA-256 of seed and id, so a document always gets the same ones.  `assemble` emits pieces of some thousand units keyed by document and
output position (a mark rides on the first piece of its part), deals them out by document and sorts them within the partitions; a
document of any length passes a task as a stream.  `verify` streams the pieces into an incremental digest, parses the marks out of the
byte stream, sends each part on under its position in the original text, sorts again within the same partition (no second exchange) and
digests the restored text.

Repeated rows (same id and text) are merged before the exchange, batch by batch, and counted, so one such row repeated a million times is
a few pieces.  Equal texts under different ids are different documents.
"""
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDER = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PLACE = {"prefix": 0, "middle": 1, "suffix": 2}         # order of the parts in the text
CHUNK_UNITS, CHUNK_BYTES = 4096, 1 << 19
FLUSH_ROWS, FLUSH_BYTES = 4096, 1 << 22


def unit_ends(raw: bytes) -> np.ndarray:
    """Byte offset behind each unit."""
    a = np.frombuffer(raw, np.uint8)
    space = (a == 32) | ((a >= 9) & (a <= 13))
    last = np.ones(len(a), bool)
    last[:-1] = space[1:]
    ends = np.flatnonzero(last & ~space) + 1
    return np.append(ends, len(a)) if len(a) and space[-1] else ends


def characters(raw: bytes) -> int:
    """Code points of UTF-8 text."""
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def draw(doc_id, n: int, seed: int = 42) -> tuple[int, int, int, int]:
    """(units of the prefix, units up to the end of the middle, form draw, order draw); a null id counts as an empty one."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    return lo, hi, c % 100, d % 100


def plan(doc_id, raw: bytes, rate: int = 50, spm_rate: int = 80, seed: int = 42) -> tuple[int, str, dict[str, tuple[int, int]], np.ndarray]:
    """(units, form, byte range of each part, unit ends) of a text."""
    ends = unit_ends(raw)
    lo, hi, c, d = draw(doc_id, len(ends), seed)
    if not raw or c >= rate or any(m in raw for m in MARKS.values()):
        return len(ends), "plain", {}, ends
    cut = [int(ends[k - 1]) if k else 0 for k in (lo, hi)]
    return len(ends), "spm" if d < spm_rate else "psm", {"prefix": (0, cut[0]), "middle": (cut[0], cut[1]), "suffix": (cut[1], len(raw))}, ends


def cut(raw: bytes, ends: np.ndarray, begin: int, stop: int) -> Iterator[bytes]:
    """Chunks of a byte range, at most CHUNK_UNITS units and CHUNK_BYTES bytes each; an empty range is one empty chunk."""
    first = int(np.searchsorted(ends, begin, "right"))
    marks = [begin, *(int(x) for x in ends[first + CHUNK_UNITS - 1::CHUNK_UNITS] if x < stop), stop]
    for a, b in zip(marks, marks[1:]):
        for at in range(a, max(b, a + 1), CHUNK_BYTES):
            yield raw[at:min(at + CHUNK_BYTES, b)]


def _fields(id_type: DataType, rest: str) -> StructType:
    return StructType([StructField("id", id_type), *StructType.fromDDL(rest).fields])


class _Rows:
    """Rows gathered into record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        if len(self.rows) >= FLUSH_ROWS or self.bytes >= FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
        self.rows, self.bytes = [], 0


def assemble(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """(id, t, pos, body, copies, n, form, prefix_chars, middle_chars): the output of every document in pieces, in output order within a
    partition; t is the hash of the text.

    The output is plain (the text), psm (<P>prefix<S>suffix<M>middle) or spm (<S>suffix<P>prefix<M>middle).  It is plain where the text is
    null or empty or holds a mark.  A null id draws as an empty id.  copies counts merged repeated rows (it is 1 on all but the first piece);
    n to middle_chars are set on the first piece only.  Other columns of docs are not read.
    """
    body = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    fields = _fields(body.schema["id"].dataType, "t long, pos long, body binary, copies long, n long, form string, prefix_chars long, middle_chars long")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, bodies = batch["id"].to_pylist(), batch["t"].to_pylist(), batch["body"]
            copies: dict[tuple, int] = {}
            for key in zip(ids, hashes):
                copies[key] = copies.get(key, 0) + 1
            out = _Rows(to_arrow_schema(fields))
            for i, key in enumerate(zip(ids, hashes)):
                c = copies.pop(key, 0)
                if not c:
                    continue
                raw = bodies[i].as_py()
                n, form, parts, ends = plan(key[0], raw, rate, spm_rate, seed)
                length = [characters(raw[slice(*parts[p])]) for p in ("prefix", "middle")] if parts else [None, None]
                pos = 0
                for part in ORDER.get(form, (None,)):
                    mark = MARKS[part] if part else b""
                    for chunk in cut(raw, ends, *(parts[part] if part else (0, len(raw)))):
                        yield from out.add((*key, pos, mark + chunk, *((c, n, form, *length) if pos == 0 else (1, None, None, None, None))), len(chunk))
                        pos, mark = pos + 1, b""
            yield from out.flush()
    return body.mapInArrow(emit, fields).repartition("id", "t").sortWithinPartitions("id", "t", "pos")


class Splitter:
    """Parses an output stream back into parts: feed gives (part, bytes); a mark may be cut anywhere between two chunks."""

    def __init__(self, form: str):
        self.expected = [(MARKS[p], p) for p in ORDER.get(form, ())]
        self.part, self.held = (None if self.expected else "prefix"), b""

    def feed(self, chunk: bytes) -> Iterator[tuple[str, bytes]]:
        data = self.held + chunk
        while self.expected:
            mark, part = self.expected[0]
            at = data.find(mark)
            if at < 0:
                break
            if at:
                yield self.part, data[:at]
            self.part, data = part, data[at + len(mark):]
            self.expected.pop(0)
        keep = min(len(data), 2) if self.expected else 0
        self.held, data = data[len(data) - keep:], data[:len(data) - keep]
        if data:
            yield self.part, data

    def end(self) -> Iterator[tuple[str, bytes]]:
        if self.expected:
            raise ValueError(f"output ends before {self.expected[0][0].decode()}")
        if self.held:
            yield self.part, self.held


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator]]:
    """(key, rows of the key) in stream order; rows are (pos, body bytes, copies, n, form, prefix_chars, middle_chars)."""
    def flat():
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            plain = [c.to_pylist() if i != 3 else c for i, c in enumerate(columns)]
            for r in range(batch.num_rows):
                yield (plain[0][r], plain[1][r]), tuple(plain[i][r].as_py() if i == 3 else plain[i][r] for i in range(2, len(plain)))
    rows = flat()
    held = next(rows, None)
    while held is not None:
        key = held[0]

        def own():
            nonlocal held
            while held is not None and held[0] == key:
                row = held[1]
                held = next(rows, None)
                yield row
        mine = own()
        yield key, mine
        for _ in mine:
            pass


def verify(assembled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row of the documents behind `assemble`'s pieces,
    which must be in its order; the restored text is rebuilt from output and form alone."""
    pieces = assembled.schema
    result = _fields(pieces["id"].dataType, "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(to_arrow_schema(pieces))
        for key, rows in _documents(batches):
            digest, copies, last, meta, split, at = hashlib.sha256(), 0, -1, None, None, {}
            for pos, body, c, *rest in rows:
                if pos == 0:
                    copies += c
                    if meta is None:
                        meta, split = rest, Splitter(rest[1])
                if pos == last:                         # the same piece of a repeated row
                    continue
                last = pos
                digest.update(body)
                for part, piece in split.feed(body):
                    n = at[part] = at.get(part, 0) + 1
                    yield from out.add((*key, (PLACE[part] << 48) + n, piece, 1, None, None, None, None), len(piece))
            for part, piece in split.end():
                yield from out.add((*key, (PLACE[part] << 48) + at.get(part, 0) + 1, piece, 1, None, None, None, None), len(piece))
            yield from out.add((*key, 0, digest.digest(), copies, *meta))
        yield from out.flush()

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(to_arrow_schema(result))
        for key, rows in _documents(batches):
            digest, meta = hashlib.sha256(), None
            for _, body, copies, *rest in rows:
                if meta is None:                        # the digest of the output stands first
                    meta = (copies, *rest, body.hex())
                else:
                    digest.update(body)
            for _ in range(meta[0]):
                yield from out.add((key[0], *meta[1:], digest.hexdigest()))
        yield from out.flush()
    restored = assembled.mapInArrow(forward, pieces).sortWithinPartitions("id", "t", "pos")
    return restored.mapInArrow(backward, result).withColumnRenamed("id", id_col)


def texts(assembled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, form, output): the outputs joined up, one row per document row; a text must fit one value here."""
    result = _fields(assembled.schema["id"].dataType, "form string, output string")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(to_arrow_schema(result))
        for key, rows in _documents(batches):
            whole, copies, last, form = [], 0, -1, None
            for pos, body, c, _, f, *_ in rows:
                copies, form = copies + c * (pos == 0), form or f
                if pos != last:
                    whole.append(body)
                last = pos
            text = b"".join(whole).decode("utf-8", "replace")
            for _ in range(copies):
                yield from out.add((key[0], form, text), len(text))
        yield from out.flush()
    return assembled.mapInArrow(join, result).withColumnRenamed("id", id_col)
