"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writer: of equal payloads the record with the largest page id is a response, the others revisit it.  Each record is a gzip member of
its own.  Repeated payloads are found by their SHA-1 and length; a payload that a third of all pages share is joined in lanes.

Reader: a member is inflated and checked (gzip checksum), then the record is checked (version line, headers, length, end mark, block
and payload digests).  After a failed check the reader searches for the next valid member or version line, goes on at the nearer
one, and logs the skipped bytes as a gap.
"""
import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof.llm.base import pieces
from placeproof.llm.files import make_folder, put
from placeproof.session import work_path

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"                           # the tables hold no fetch time
LANES = 32
MEMBER = b"\x1f\x8b\x08"
FIELDS = "file string, kind string, begin long, stop long, reason string, record_id string, record_type string, target string, payload_bytes long, payload_digest string, refers_to string, payload binary"
RECORD_ID = re.compile(r"<urn:uuid:([0-9a-f]{8})-0000-4000-8000-0000([0-9a-f]{8})>")


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a 160-bit digest: each five hexadecimal digits give four characters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def four(i: Column) -> Column:
        n = F.conv(F.substring(hex_digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(letters), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def record_id(page_id: int) -> str:
    """A fixed identifier that holds the page id."""
    h = f"{page_id & (1 << 64) - 1:016x}"
    return f"<urn:uuid:{h[:8]}-0000-4000-8000-0000{h[8:]}>"


def page_id(identifier: str | None) -> int | None:
    m = RECORD_ID.fullmatch(identifier or "")
    n = int(m[1] + m[2], 16) if m else None
    return n - (1 << 64) if n is not None and n >= 1 << 63 else n


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:none"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 1, compress: bool = True) -> bytes:
    """One record, by default as a gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page) if page is not None else '<urn:none>'}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}",
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not compress:
        return raw
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(pages: DataFrame, least: int = 0, file_bytes: int = 32 << 20) -> str:
    """Write a record per row of (page_id, url, html) and give the folder.

    Payloads of fewer than `least` bytes are never revisited.  A null html is an empty payload, a null url a fixed address.  Rows that
    repeat page and payload are responses each; an empty table gives an empty folder; a row without page id revisits like any other and never is the one referred to.
    """
    folder = work_path(pages.sparkSession, "warc")
    make_folder(folder)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).cast("long").alias("size"))
    repeated = rows.filter(F.col("size") >= least).groupBy("sha", "size").agg(F.max("page_id").alias("origin"), F.count("*").alias("n")).filter("n > 1 and origin is not null")
    lane = F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))
    laned = rows.withColumn("lane", F.pmod(F.xxhash64("page_id", "url"), F.lit(LANES)).cast("int"))
    placed = (laned.join(repeated.select("sha", "size", "origin", lane.alias("lane")), ["sha", "size", "lane"], "left")
              .select("page_id", "url", "html", base32(F.col("sha")).alias("digest"), F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("origin")), F.col("origin")).alias("refers_to")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{count:04d}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([put(folder, name, held)])], ["name", "size"])
        for batch in batches:
            for piece in pieces(batch, "html"):
                for page, url, body, digest, origin in zip(*(piece[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    held.append(record(page, url, body.encode("utf-8", "replace"), digest, origin))
                    size += len(held[-1])
                    if size >= file_bytes:
                        yield flush()
                        count, held, size = count + 1, [], 0
        if held:
            yield flush()
    placed.mapInArrow(write, "name string, size long").collect()
    return folder


def _inflate(data: memoryview, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """(content, end) of the gzip member that begins at a byte; raises zlib.error if it is not whole."""
    z, out = zlib.decompressobj(31), []
    while not z.eof:
        if at >= len(data):
            raise zlib.error("cut short")
        out.append(z.decompress(data[at:at + step]))
        at = min(len(data), at + step)
    return b"".join(out), at - len(z.unused_data)


def _parse(raw: bytes, whole: bool) -> tuple[dict, bytes, bytes, int]:
    """(headers, block head, payload, end) of the record that begins the bytes; raises ValueError if a check fails.

    whole: nothing may follow the record.
    """
    if not re.match(rb"WARC/\d+\.\d+\r\n", raw):
        raise ValueError("no version line")
    split = raw.find(b"\r\n\r\n")
    if split < 0:
        raise ValueError("headers do not end")
    head: dict[str, str] = {}
    for line in raw[:split].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("bad header line")
        head[name.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdigit():
        raise ValueError("no length")
    end = split + 4 + int(head["content-length"])
    if raw[end:end + 4] != b"\r\n\r\n" or whole and len(raw) != end + 4:
        raise ValueError("length does not fit")
    block = raw[split + 4:end]
    if not _digest_fits(head.get("warc-block-digest"), block):
        raise ValueError("block digest differs")
    top, gap, payload = block.partition(b"\r\n\r\n")
    if head.get("warc-type") == "response" and gap and not _digest_fits(head.get("warc-payload-digest"), payload):
        raise ValueError("payload digest differs")
    return head, top, payload, end + 4


def _digest_fits(value: str | None, content: bytes) -> bool:
    kind, _, want = (value or "").partition(":")
    return kind.lower() != "sha1" or base64.b32encode(hashlib.sha1(content).digest()).decode() == want.upper()


def salvage(data: memoryview) -> Iterator[tuple]:
    """("record", begin, end, headers, block head, payload) and ("gap", begin, end, reason), in file order, covering every byte.

    A failed place is skipped up to the next gzip member or line with a version mark, whichever comes first and is valid: a damaged
    beginning does not decide what the file is.
    """
    at, bad, reason, size, raw = 0, None, "", len(data), bytes(data)
    marks = {MEMBER: -1, b"WARC/": -1}                  # next place of each, found once
    line = re.compile(rb"(?:\A|(?<=\n))WARC/")

    def following(start: int) -> int:
        if marks[MEMBER] < start:
            n = raw.find(MEMBER, start)
            marks[MEMBER] = n if n >= 0 else size
        if marks[b"WARC/"] < start:
            m = line.search(raw, start)
            marks[b"WARC/"] = m.start() if m else size
        return min(marks.values())
    while at < size:
        try:
            if raw.startswith(b"WARC/", at):
                head, top, payload, end = _parse_at(raw, at)
            else:
                content, end = _inflate(data, at)
                head, top, payload, _ = _parse(content, True)
        except (zlib.error, ValueError) as e:
            if bad is None:
                bad, reason = at, str(e)
            at = following(at + 1)
            continue
        if bad is not None:
            yield "gap", bad, at, reason
            bad = None
        yield "record", at, end, head, top, payload
        at = end
    if bad is not None:
        yield "gap", bad, size, reason


def _parse_at(raw: bytes, at: int) -> tuple[dict, bytes, bytes, int]:
    """One record of a plain file: its length is read first so that only its bytes are copied."""
    split = raw.find(b"\r\n\r\n", at)
    m = re.search(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*(?:\r\n|$)", raw[at:split] if split >= 0 else b"", re.I)
    if not m:
        raise ValueError("no version line or length")
    stop = split + 8 + int(m[1])
    head, top, payload, used = _parse(raw[at:stop], True)
    return head, top, payload, at + used


def read_archives(spark, folder: str, with_payload: bool = True, glob: str = "*.warc*") -> DataFrame:
    """A row per record and per gap (kind) of all files: file, kind, begin, stop, reason, record_id, record_type, target,
    payload_bytes, payload_digest, refers_to, payload.

    payload_bytes and payload_digest are those of the full payload, also of revisits; gaps have null record columns; empty files give
    no rows.  Files are read whole, one per row: write them in bounded sizes, as the writer does.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in FIELDS.split(", ")]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                rows, held = [], 0
                for kind, begin, end, *rest in salvage(memoryview(content.as_buffer())):
                    if kind == "gap":
                        rows.append((path, kind, begin, end, rest[0], *[None] * 7))
                    else:
                        head, top, payload = rest
                        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", top)
                        full = int(length[1]) if length and head.get("warc-type") == "revisit" else len(payload)
                        rows.append((path, kind, begin, end, None, head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), full,
                                     head.get("warc-payload-digest", "").removeprefix("sha1:"), head.get("warc-refers-to"), payload if with_payload else None))
                        held += len(payload) if with_payload else 0
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")
    return files.mapInArrow(run, FIELDS)
