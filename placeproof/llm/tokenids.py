"""Token ids of a corpus as Huffman-coded binary files in id order.

File: magic, then a compressed header (first global position, code lengths by id), blocks, and an end mark.  A block holds whole
documents (ids, counts, byte sizes), the bit lengths of its segments of 256 ids as checkpoints, the coded bits, and a checksum; it can
be decoded alone, and a segment can be decoded from its checkpoint alone.  The code is canonical, limited to 18 bits, and made from the
counts of all ids; the counts are one number per vocabulary entry.

Tokenising works on white-space words, each distinct word of a batch once; the vocabulary's patterns never span white space, so the ids
are those of the whole text (a class for vocabularies whose patterns do is not given).
"""
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof.llm import huffman
from placeproof.llm.base import pieces, stage
from placeproof.llm.files import put
from placeproof.session import work_path

MAGIC, BLOCK, STOP = b"HUFIDS1\n", b"BLCK", b"DONE"
WORDS_PER_CALL = 1000
CLOSING = ",.;:!?"
IDS_AT_ONCE = 500_000
KEPT = 500_000                                          # words whose ids a worker process keeps, under 100 MB


class Words:
    """Encodes many distinct white-space words with few calls.

    A word of letters is one unit of the vocabulary's patterns: such words are joined by spaces and told apart by the units' last
    pieces.  A closing mark behind letters that stay letters when normalised is a unit too, so such a word is put together of both.  All other words are joined by a
    special token; those that hold it themselves are encoded alone.
    """
    def __init__(self, path: str, mark: str = "<|startoftext|>"):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.mark, self.sep = mark, self.tok.token_to_id(mark)
        names = self.tok.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)
        self.last[[i for n, i in names.items() if n.endswith("</w>")]] = True
        self.closing = {c: int(ids[0]) for c in CLOSING if len(ids := self._ids(c)) == 1}
        self._keep({}, np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if any(self.mark in w for w in words):
            each = [self._ids(w) for w in words]
            return np.concatenate(each), np.array([len(x) for x in each])
        ids = self._ids(self.mark.join(words))
        cut = np.flatnonzero(ids == self.sep)
        return ids[ids != self.sep], np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(" ".join(words))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):                     # lower-casing made a mark of a letter somewhere
            return self._apart(words)
        return ids, np.diff(np.concatenate([[0], ends]))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words in some order, where each word's ids begin, how many they are)."""
        letters = np.fromiter(map(str.isalpha, words), bool, len(words))
        place = {words[i]: int(i) for i in np.flatnonzero(letters)}
        every, other, closed, bases, marks = list(words), [], [], [], []
        for i in np.flatnonzero(~letters).tolist():
            w = words[i]
            # Where normalising ends the letters with a mark, that mark and the closing one are a unit together.
            if w[-1:] in self.closing and w[:-1].isalpha() and (w.isascii() or unicodedata.normalize("NFC", w[:-1]).lower().isalpha()):
                base = place.get(w[:-1])
                if base is None:
                    base = place[w[:-1]] = len(every)
                    every.append(w[:-1])
                closed.append(i)
                bases.append(base)
                marks.append(self.closing[w[-1]])
            elif w:
                other.append(i)
        flat, first, size, at = [np.zeros(0, np.uint32)], np.zeros(len(every), np.int64), np.zeros(len(every), np.int64), 0
        for places, how in ((np.array(list(place.values()), np.int64), self._letters), (np.array(other, np.int64), self._apart)):
            for lo in range(0, len(places), WORDS_PER_CALL):
                some = places[lo:lo + WORDS_PER_CALL]
                ids, n = how([every[i] for i in some])
                flat.append(ids)
                first[some], size[some] = at + np.cumsum(n) - n, n
                at += len(ids)
        whole = np.concatenate(flat)
        if closed:
            b = np.array(bases)
            n = size[b]
            body = whole[np.repeat(first[b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            first[closed], size[closed] = at + np.cumsum(n + 1) - (n + 1), n + 1
            whole = np.concatenate([whole, np.insert(body, np.cumsum(n), marks).astype(np.uint32)])
        return whole, first[:len(words)], size[:len(words)]

    def _keep(self, rows: dict[str, int], flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        self.rows, self.flat, self.first, self.size = rows, flat, first, size

    def known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`encode` for distinct words, only of those that no batch before has shown; past KEPT words, those of the last batch stay."""
        row = np.fromiter((self.rows.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(row < 0)
        names = [words[i] for i in new.tolist()]
        flat, first, size = self.encode(names)
        row[new] = len(self.first) + np.arange(len(new))
        first = np.concatenate([self.first, len(self.flat) + first])
        size = np.concatenate([self.size, size])
        flat = np.concatenate([self.flat, flat])
        if len(first) <= KEPT:
            self.rows.update(zip(names, row[new].tolist()))
            self._keep(self.rows, flat, first, size)
        else:
            own = words[:KEPT]
            f, n = first[row[:KEPT]], size[row[:KEPT]]
            at = np.cumsum(n) - n
            self._keep({w: i for i, w in enumerate(own)}, flat[np.repeat(f - at, n) + np.arange(int(n.sum()))], at, n)
        return flat, first[row], size[row]


_WORDS: dict[str, Words] = {}                           # per worker process


def tokenise(texts: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, ids, number of ids of each text) of runs of texts, every text closed by end_id; null is an empty text."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    upto = split.offsets.to_numpy().astype(np.int64)
    upto -= upto[0]
    coded = split.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    flat, first, size = _WORDS[path].known(coded.dictionary.to_pylist())
    done = np.concatenate([[0], np.cumsum(size[index])]) if len(index) else np.zeros(1, np.int64)
    n_text = np.diff(done[upto])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(done[upto], done[upto[at]] + IDS_AT_ONCE, "right")) - 1)
        w = index[upto[at]:upto[end]]
        here = done[upto[at]:upto[end]] - done[upto[at]]
        body = flat[np.repeat(first[w] - here, size[w]) + np.arange(int(n_text[at:end].sum()))]
        yield at, np.insert(body, np.cumsum(n_text[at:end]), end_id).astype(np.uint32), n_text[at:end] + 1
        at = end


def _cuts_below(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are below the value (null: none), by binary search in one literal: the expression does not grow with the cuts."""
    if not cuts:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    held = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")          # folded to one literal by the optimizer
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(held, at + step - 1) < value), at + step).otherwise(at))


def encode_corpus(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = 1, ids_per_file: int = 8_000_000) -> str:
    """Write the files and give their folder.

    Documents are ordered by id, null ids first; rows that repeat an id stand together in one file, in the order of their ids' bytes.
    Null and empty texts are the end id alone.  An empty table gives a folder with one file without documents.
    """
    spark = docs.sparkSession
    body = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("body"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "body", 1 << 24, 10_000):
                for at, ids, n in tokenise(part["body"], tokenizer, end_id):
                    small = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4")
                    ends = np.concatenate([[0], np.cumsum(n)]) * small.itemsize
                    blobs = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(small.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([part["id"].slice(at, len(n)), pa.array(n), blobs], ["id", "n", "ids"])
    coded = stage(body.mapInArrow(tokens, "id long, n long, ids binary"), "token-ids", compression="zstd")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for part in _runs(batches):
            ids, _ = _ids_of(part)
            c = np.bincount(ids)
            if len(c) > len(total):
                c[:len(total)] += total
                total = c
            else:
                total[:len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "c"])
    rows = coded.mapInArrow(tally, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(max([r["token"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        counts[r["token"]] = r["c"]
    lengths = huffman.code_lengths(counts)
    cast = spark.sparkContext.broadcast((lengths, huffman.canonical(lengths)))

    files = max(1, -(-int(counts.sum()) // ids_per_file))
    cuts = coded.filter("id is not null").agg(F.percentile_approx("id", [i / files for i in range(1, files)] or [0.5], 100 * files)).first()[0] or [] if files > 1 else []
    part = _cuts_below(F.col("id"), sorted(set(cuts)))
    placed = coded.withColumn("part", part)
    totals = placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    base, at = {}, 0
    for r in totals:
        base[r["part"]], at = at, at + r["n"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lens, codes = cast.value
        for part in _runs(batches):
            ids, n = _ids_of(part)
            raw, size, bits = huffman.encode(ids, n, codes, lens)
            ends, seg = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(-(-n // huffman.SEGMENT))])
            yield pa.RecordBatch.from_arrays([part["part"], part["id"], pa.array(n), pa.array([raw[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
                                              pa.array([bits[a:b].tobytes() for a, b in zip(seg, seg[1:])], pa.binary())], ["part", "id", "n", "bits", "seg"])
    folder = work_path(spark, "huffman")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lens, _ = cast.value
        held: dict = {}

        def chunks(first, rest):
            head = zlib.compress(struct.pack("<q", base[held["part"]]) + lens.tobytes())
            yield MAGIC + struct.pack("<I", len(head)) + head
            for group in _groups(first, rest):
                yield _block(group)
            yield STOP

        rows = (r for b in batches for r in b.to_pylist())
        first = next(rows, None)
        while first is not None:                        # one part in a partition, or several when partitions are fewer
            held["part"], held["next"] = first["part"], None

            def same():
                for r in rows:
                    if r["part"] != held["part"]:
                        held["next"] = r
                        return
                    yield r
            name = f"part-{held['part']:06d}.huf"
            size = put(folder, name, chunks(first, same()))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size])], ["name", "size"])
            first = held["next"]
    packed = placed.select("part", "id", "n", "ids").mapInArrow(pack, "part int, id long, n long, bits binary, seg binary")
    written = packed.repartitionById(max(base, default=0) + 1, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("id"), "bits").mapInArrow(write, "name string, size long").collect()
    if not written:
        put(folder, "part-000000.huf", [MAGIC + struct.pack("<I", len(h := zlib.compress(struct.pack("<q", 0)))) + h, STOP])
    return folder


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with a bounded number of ids (a longer document is a slice of its own)."""
    for batch in batches:
        upto = np.concatenate([[0], np.cumsum(batch["n"].to_numpy())])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + IDS_AT_ONCE, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def _ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch["n"].to_numpy().astype(np.int64)
    raw = [x.as_buffer() for x in batch["ids"]]
    if all(len(r) == 2 * k for r, k in zip(raw, n)):
        return np.frombuffer(b"".join(raw), "<u2").astype(np.int64), n
    return np.concatenate([np.frombuffer(r, "<u2" if len(r) == 2 * k else "<u4") for r, k in zip(raw, n)]).astype(np.int64), n


def _groups(first: dict, rest: Iterator[dict], size: int = 1 << 20) -> Iterator[list[dict]]:
    group, held = [first], len(first["bits"])
    for r in rest:
        if held >= size:
            yield group
            group, held = [], 0
        group.append(r)
        held += len(r["bits"])
    yield group


def _block(rows: list[dict]) -> bytes:
    null = np.array([r["id"] is None for r in rows], np.uint8)
    meta = zlib.compress(np.array([r["id"] or 0 for r in rows], "<i8").tobytes() + np.array([r["n"] for r in rows], "<i8").tobytes()
                         + np.array([len(r["bits"]) for r in rows], "<i8").tobytes() + null.tobytes())
    seg, bits = b"".join(r["seg"] for r in rows), b"".join(r["bits"] for r in rows)
    body = meta + seg + bits
    return BLOCK + struct.pack("<IIIQI", len(rows), len(meta), len(seg), len(bits), zlib.crc32(body)) + body


def read_blocks(data: memoryview) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(global position of the block, document ids, counts, ids) of a file; a damaged file raises."""
    if bytes(data[:8]) != MAGIC:
        raise ValueError("not a token-id file")
    n = struct.unpack("<I", data[8:12])[0]
    head = zlib.decompress(data[12:12 + n])
    at, position = 12 + n, struct.unpack("<q", head[:8])[0]
    ids, size = huffman.decode_table(np.frombuffer(head[8:], np.uint8))
    while bytes(data[at:at + 4]) == BLOCK:
        rows, n_meta, n_seg, n_bits, check = struct.unpack("<IIIQI", data[at + 4:at + 28])
        body = data[at + 28:at + 28 + n_meta + n_seg + n_bits]
        if zlib.crc32(body) != check:
            raise ValueError("damaged block")
        meta = zlib.decompress(body[:n_meta])
        names, counts, sizes = (np.frombuffer(meta, "<i8", rows, 8 * rows * i) for i in range(3))
        null = np.frombuffer(meta, np.uint8, rows, 24 * rows)
        got = huffman.decode(np.frombuffer(body[n_meta + n_seg:], np.uint8), counts, sizes, np.frombuffer(body[n_meta:n_meta + n_seg], np.uint16), ids, size)
        yield position, [None if z else int(x) for x, z in zip(names, null)], counts, got
        position += int(counts.sum())
        at += 28 + len(body)
    if bytes(data[at:at + 4]) != STOP:
        raise ValueError("file is cut short")


def read_corpus(spark, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids) of all files; ids as little-endian unsigned 32-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                for at, names, n, ids in read_blocks(memoryview(content.as_buffer())):
                    ends = np.concatenate([[0], np.cumsum(n)])
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(at + ends[:-1]), pa.array(n), pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:])], pa.binary())],
                                                     ["id", "start", "n_tokens", "ids"])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.huf").load(folder).select("content")
    return files.mapInArrow(run, "id long, start long, n_tokens long, ids binary")
