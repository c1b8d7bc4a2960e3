"""N-gram Jaccard join over parity sketches.

A set of shingle hashes is drawn as a bit sketch of w words: each hash picks a word and xors a 64-bit pattern of its own into it, so two
sketches differ in at most as many words as the sets differ in elements.  Sets that reach the similarity differ in at most d elements,
and d follows from the sizes; of the w words at least w - d are equal (pigeonhole).  Sizes form levels whose ratio is the threshold;
partners are in the same or the next level, so each set is drawn in the layouts of two neighbouring level pairs and (layout, word
number, word) is an equi-join key.  Words that few elements fall into are equal in many unrelated sets.  A set leaves out its words of up to
j elements for the largest j at which these are fewer than w - d: then one of the equal words has more, also more than the partner's j,
and both sets keep it.

Equal sets are folded first.  Buckets of a key are streamed in key order and only those with different sets remain.  Round one compares
each member with the member of most buckets (the likely original of a group of copies).  Round two takes the sets of buckets whose members
are still in different components.  They would be all pairs of a bucket where a passage is common to many documents, so they do not meet
on the bucket again: their shingles are put in one order, rare ones first, and two sets that reach the similarity share one among the
first n - ceil(t n) + 1 of each (prefix filter, with bounds by size and position in the join condition).  Frequent passages stand last.
So a group of n near copies costs about n comparisons, while any pair whose link could join two components is compared: the components are
exact.  Verification first bounds the difference by the Hamming distance of parity sketches (one bit an element) that both sets can be
folded to, then counts the intersection; whole sets are only made for the pairs that pass the sketches and for round two.

Sets are identified by a 64-bit hash, shingles too: a false equality has a chance near 1e-9 for 100,000 documents.
"""
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof.llm.base import pieces, stage
from placeproof.llm.components import components, key_filter, may_match
from placeproof.llm.shingles import mix, set_hash, shingle_sets


def level_floors(num: int, den: int, most: int = 1 << 40) -> np.ndarray:
    """Smallest size of each level: one more than the largest partner of the level before."""
    floors = [1]
    while floors[-1] < most:
        floors.append(floors[-1] * den // num + 1)
    return np.array(floors, np.int64)


MOST_LEFT_OUT = 6                                       # elements of the words that may be left out
PATTERN = np.uint64(0x9E6C63D0876A9A47)
SLOTS = 1 << 18                                         # counters of shingles by hash, in parts: 2 MB whatever the corpus
SLOT_PART = 1 << 12


def layout_words(floors: np.ndarray, layout: np.ndarray, num: int, den: int) -> np.ndarray:
    """Words of a layout: somewhat more than the largest difference of two linked sets of its two levels."""
    most = 2 * (floors[layout + 2] - 1) * (den - num) // (den + num)
    return most + 3 + most * 3 // 20


def sure_equal(size: np.ndarray, words: np.ndarray, top: np.ndarray, num: int, den: int) -> np.ndarray:
    """Words that a set surely has in common with any linked set of the layout, whose sets have up to `top` elements."""
    partner = np.minimum(top, size * den // num)
    return words - (size + partner) * (den - num) // (den + num)


def sketch_keys(sets: list[np.ndarray], nodes: np.ndarray, floors: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, node) of the words of both layouts of each set."""
    size = np.array([len(s) for s in sets])
    level = np.searchsorted(floors, size, "right") - 1
    h = np.concatenate(sets)
    keys, owners = [], []
    for back in (0, 1):
        layout = np.maximum(level - back, 0)
        words = np.where((level >= back) & (size > 0), layout_words(floors, layout, num, den), 0)
        base = np.concatenate([[0], np.cumsum(words)[:-1]])
        of = np.repeat(np.arange(len(sets)), np.where(words > 0, size, 0))
        used = h[np.repeat(words > 0, size)]
        word = base[of] + ((used >> np.uint64(6)) % words[of].astype(np.uint64)).astype(np.int64)
        filled = np.bincount(word, minlength=int(words.sum()))
        some = filled > 0
        value = np.zeros(len(filled), np.uint64)
        if some.any():
            ordered = mix(used ^ PATTERN)[np.argsort(word, kind="stable")]
            value[some] = np.bitwise_xor.reduceat(ordered, (np.cumsum(filled) - filled)[some])
        owner = np.repeat(np.arange(len(sets)), words)
        equal = sure_equal(size, words, floors[layout + 2] - 1, num, den)
        drop = np.full(len(sets), -1)
        for j in range(MOST_LEFT_OUT):
            fewer = np.bincount(owner[filled <= j], minlength=len(sets)) < equal
            drop[fewer & (drop == j - 1)] = j
        keep = filled > drop[owner]
        where = mix((layout[owner].astype(np.uint64) << np.uint64(40)) + (np.arange(len(value)) - base[owner]).astype(np.uint64) + np.uint64(1))
        keys.append(mix(value ^ where)[keep])
        owners.append(nodes[owner[keep]])
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def parity_sketch(h: np.ndarray) -> np.ndarray:
    """Sketch of 4 to 8 bits per element, a power of two of them (64 at least)."""
    bits = max(64, 1 << int(4 * len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def digest(h: np.ndarray) -> list[int]:
    """The 512-bit sketch of a set, as eight signed integers."""
    bits = (np.bincount((h & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set with fewer words: its halves xored."""
    while len(sketch) > words:
        sketch = sketch[:len(sketch) // 2] ^ sketch[len(sketch) // 2:]
    return sketch


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) in order; those whose key has another node pass, equal rows once."""
    held = np.zeros((0, 2), np.int64)
    before = None                                       # key of the last row that is no longer held

    def shared(rows: np.ndarray, prior, last: bool) -> tuple[np.ndarray, np.ndarray]:
        keep = np.ones(len(rows), bool)
        keep[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        rows = rows[keep]
        same = np.zeros(len(rows) + 1, bool)
        same[1:-1] = rows[1:, 0] == rows[:-1, 0]
        same[0] = prior is not None and len(rows) > 0 and rows[0, 0] == prior
        multi = same[:-1] | same[1:]
        return (rows[multi], rows[:0]) if last else (rows[:-1][multi[:-1]], rows[-1:])
    for batch in batches:
        rows = np.concatenate([held, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)])
        if not len(rows):
            continue
        done, held_next = shared(rows, before, False)
        gone = rows[(rows != held_next[-1]).any(axis=1)]
        before = gone[-1, 0] if len(gone) else before
        held = held_next
        if len(done):
            yield pa.RecordBatch.from_arrays([pa.array(done[:, 0]), pa.array(done[:, 1])], ["key", "node"])
    if len(held):
        done, _ = shared(held, before, True)
        if len(done):
            yield pa.RecordBatch.from_arrays([pa.array(done[:, 0]), pa.array(done[:, 1])], ["key", "node"])


def _sides(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    for x in ("a", "b"):
        pairs = pairs.join(of.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns]), x)
    return pairs


def _nodes_of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of each node that is in a pair."""
    wanted = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "set-wanted")
    return may_match(rows, "node", key_filter(wanted, "node")).join(wanted, "node").dropDuplicates(["node"])


DIGEST = [f"g{i}" for i in range(8)]


def _digests(every: DataFrame) -> DataFrame:
    """(node, n, g0 ... g7): size and 512-bit sketch of each set."""
    return every.groupBy("node").agg(F.max("n").alias("n"), F.first("g").alias("g")).select("node", "n", *[F.col("g")[i].alias(g) for i, g in enumerate(DIGEST)])


def _possible(x: str, y: str, num: int, den: int) -> Column:
    """Whether two sets, by their prefixed digest columns, may reach the similarity."""
    apart = reduce(add, [F.bit_count(F.col(f"{x}{g}").bitwiseXOR(F.col(f"{y}{g}"))) for g in DIGEST])
    small, large = F.least(f"{x}n", f"{y}n"), F.greatest(f"{x}n", f"{y}n")
    return (small * den >= large * num) & (apart * (den + num) <= (small + large) * (den - num))


def _verify(pairs: DataFrame, every: DataFrame, whole, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that reach the similarity: small sketches first, then large ones, then the sets.  whole: rows with t -> (node, h)."""
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_n, b_n = batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
            ok = np.minimum(a_n, b_n) * den >= np.maximum(a_n, b_n) * num
            most = (a_n + b_n) * (den - num) // (den + num)
            for i in np.flatnonzero(ok):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("a_s", "b_s"))
                words = min(len(x), len(y))
                ok[i] = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= most[i]
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("a_h", "b_h"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = den * both >= num * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(ok))
    pairs = stage(_sides(pairs, _digests(every), "n", *DIGEST).filter(_possible("a_", "b_", num, den)).select("a", "b"), "set-pairs")
    sketches = stage(_nodes_of(pairs, every.select("node", "n", "s")), "set-sketches")
    few = stage(_sides(pairs, sketches, "n", "s").select("a", "b", "a_n", "b_n", "a_s", "b_s").mapInArrow(near, "a long, b long"), "set-near")
    sets = stage(whole(_nodes_of(few, every.select("node", "t")).select("t")), "set-members")
    return stage(_sides(few, sets, "h").select("a", "b", "a_h", "b_h").mapInArrow(linked, "a long, b long"), "set-links")


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """How many elements of all sets (h) fall into each of SLOTS slots: tasks send their counters in parts, and parts are summed as they come."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("h")[at:at + 256]])
                counts += np.bincount((h % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        parts = counts.reshape(-1, SLOT_PART)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch["part"].to_pylist(), batch["counts"]):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts.as_buffer(), np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], ["part", "counts"])
    got = sets.select("h").mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(total, "part int, counts binary").collect()
    out = np.zeros((SLOTS // SLOT_PART, SLOT_PART), np.int64)
    for r in got:
        out[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def _prefix_pairs(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of sets (node, c, h) of different components c that may reach the similarity, by the prefix filter."""
    counts = sets.sparkSession.sparkContext.broadcast(_slot_counts(sets))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h = np.frombuffer(batch.column("h")[i].as_buffer(), np.uint64)
                n = len(h)
                take = n - -(-num * n // den) + 1
                order = np.lexsort((h, counts.value[(h % np.uint64(SLOTS)).astype(np.int64)]))[:take]
                yield pa.RecordBatch.from_arrays([pa.array(h[order].view(np.int64)), pa.array(np.full(take, batch.column("node")[i].as_py(), np.int64)), pa.array(np.full(take, batch.column("c")[i].as_py(), np.int64)),
                                                  pa.array(np.full(take, n, np.int32)), pa.array(np.arange(take, dtype=np.int32))], ["s", "node", "c", "n", "pos"])
    rows = stage(sets.mapInArrow(prefix, "s long, node long, c long, n int, pos int"), "set-prefixes")
    x, y = (rows.select("s", *[F.col(f).alias(f"{v}_{f}") for f in ("node", "c", "n", "pos")]) for v in ("x", "y"))
    left = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    fits = (F.col("x_c") < F.col("y_c")) & (F.least("x_n", "y_n") * den >= F.greatest("x_n", "y_n") * num) & (left * (den + num) >= (F.col("x_n") + F.col("y_n")) * num)
    return x.join(y, "s").filter(fits).select(*_pair("x_node", "y_node")).distinct()


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100, detail: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) of every row: documents with Jaccard similarity of num / den or more of their k-word shingles
    are linked; component_id is the smallest id reachable.

    Null, empty and blank texts have an empty set and are linked with nothing.  Repeated rows and equal sets are one class.  A null
    id takes part; its component_id is the smallest non-null id of its class, if any.

    detail: also text_hash, the xxhash64 of the row's text, and component, which tells classes apart even where an id stands on several
    texts (null for empty sets).
    """
    floors = level_floors(num, den)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    body = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("body"))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "body"):
                sets = shingle_sets(part["body"].to_pylist(), k)
                yield pa.RecordBatch.from_arrays([part["id"], part["t"], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) for s in sets], pa.int64()),
                                                  pa.array([parity_sketch(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                                                  pa.array([digest(s) for s in sets], pa.list_(pa.int64()))], ["id", "t", "n", "node", "s", "g"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()                          # sets of this task: copies are drawn once
        for batch in batches:
            for part in pieces(batch, "body"):
                fresh = []
                for s in shingle_sets(part["body"].to_pylist(), k):
                    node = set_hash(s)
                    if len(s) and node not in seen:
                        seen.add(node)
                        fresh.append((node, s))
                if fresh:
                    key, owner = sketch_keys([s for _, s in fresh], np.array([n for n, _ in fresh], np.int64), floors, num, den)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner)], ["key", "node"])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "body"):
                sets = [s for s in shingle_sets(part["body"].to_pylist(), k) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "h"])

    def whole(wanted: DataFrame) -> DataFrame:
        wanted = stage(wanted.distinct(), "set-texts")
        texts = may_match(body, "t", key_filter(wanted, "t")).join(wanted, "t").dropDuplicates(["t"]).select("body")
        return texts.mapInArrow(full, "node long, h binary").dropDuplicates(["node"])

    every = stage(body.mapInArrow(nodes, f"id {kind}, t long, n long, node long, s binary, g array<long>"), "sets")
    spread = body.select("body").mapInArrow(keys, "key long, node long").repartition("key").sortWithinPartitions("key", "node")
    met = stage(spread.mapInArrow(_buckets, "key long, node long"), "set-buckets", release=True)
    weight = met.groupBy("node").agg(F.count("*").alias("w"))
    centre = met.join(weight, "node").groupBy("key").agg(F.max(F.struct("w", F.col("node").alias("c"))).alias("m")).select("key", F.col("m.c").alias("centre"))
    placed = stage(met.join(centre, "key"), "set-stars", release=True)
    links = _verify(placed.filter("node != centre").select(*_pair("node", "centre")).distinct(), every, whole, num, den)
    known = components(links)
    classes = placed.filter("node != centre").join(known, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    mixed = classes.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("key")
    open_ = stage(classes.join(mixed, "key", "left_semi").select("node", "c").distinct(), "set-open", release=True)
    sets = stage(whole(_nodes_of(open_.select(F.col("node").alias("a"), F.col("node").alias("b")), every.select("node", "t")).select("t")).join(open_, "node"), "set-open-members", release=True)
    across = stage(_prefix_pairs(sets, num, den), "set-across")
    final = components(links.union(_verify(across, every, whole, num, den)))

    folded_ = every.groupBy("node").agg(F.min("id").alias("id"))
    member = folded_.join(final, "node", "left").select("node", "id", F.coalesce("component", "node").alias("c"))
    root = member.groupBy("c").agg(F.min("id").alias("component_id"))
    named = member.join(root, "c").select("node", "component_id", F.col("c").alias("component"))
    more = [F.col("t").alias("text_hash"), "component"] if detail else []
    linked = every.filter("n > 0").join(named, "node").select("id", "n", "component_id", *more)
    more = [F.col("t").alias("text_hash"), F.lit(None).cast("long").alias("component")] if detail else []
    alone = every.filter("n = 0").select("id", "n", F.col("id").alias("component_id"), *more)
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), *out.columns[2:])
