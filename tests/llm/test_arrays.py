"""The array parts without Spark: codes, sketches, boundaries, shingles."""
import base64
import hashlib
import heapq
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from placeproof.llm import huffman, mixing, packing, setjoin, shingles, warc


def entropy_cost(counts):
    heap, total = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@pytest.mark.parametrize("n", [1, 2, 3, 100, 5000])
def test_code_lengths_are_optimal_and_prefix_free(n):
    counts = (np.random.default_rng(n).pareto(1.2, n) * 9).astype(np.int64)
    counts[0] = 3
    length = huffman.code_lengths(counts)
    assert (2.0 ** -length[length > 0].astype(float)).sum() <= 1 and length.max() <= huffman.MOST_BITS
    if (counts > 0).sum() > 1:
        assert (length * counts).sum() == entropy_cost(counts.tolist())


def test_code_lengths_stay_under_the_limit():
    counts = np.array([int(1.7**i) + 1 for i in range(60)], np.int64)
    length = huffman.code_lengths(counts)
    assert length.max() == huffman.MOST_BITS and (2.0 ** -length.astype(float)).sum() <= 1


def test_huffman_round_trip():
    rng = np.random.default_rng(2)
    counts = (rng.pareto(1.0, 3000) * 30).astype(np.int64) + 1
    length = huffman.code_lengths(counts)
    n = np.array([0, 1, 255, 256, 257, 0, 5000, 3], np.int64)
    ids = rng.choice(3000, n.sum(), p=counts / counts.sum())
    raw, size, seg = huffman.encode(ids, n, huffman.canonical(length), length)
    assert (huffman.decode(raw, n, size, seg, *huffman.decode_table(length)) == ids).all()


def words(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_long_words_have_their_own_hashes():
    words_ = ["".join(x) for x in itertools.product("abó", repeat=7)] + ["prefixprefix" + c * k for c in "abc" for k in range(1, 60)]
    h, _ = shingles.word_hashes([" ".join(words_)])
    assert len(set(h.tolist())) == len(set(words_))


@pytest.mark.parametrize("stretch", [1 << 22, 40])
def test_shingle_sets_match_plain_sets(stretch, monkeypatch):
    monkeypatch.setattr(shingles, "BYTES", stretch)
    random.seed(3)
    texts = [None, "", " \n\t", "A", "a b", "A b C", "é x y\x0bz Q\x85r", "w" * 200 + " w w w w w"] + [" ".join(random.choice("abcAB") for _ in range(random.randint(1, 90))) for _ in range(60)]
    got, want = shingles.shingle_sets(texts, 4), [words(t, 4) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i, j in itertools.product(range(0, len(texts), 3), repeat=2):
        assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_linked_sets_always_share_a_key_and_the_sketch_bounds_the_difference():
    num, den = 85, 100
    floors, rng = setjoin.level_floors(num, den), np.random.default_rng(4)
    linked = 0
    for n in (1, 5, 6, 7, 12, 13, 14, 20, 27, 50, 80, 300, 3000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[int(rng.integers(0, n // 6 + 1)):]], rng.integers(0, 1 << 62, int(rng.integers(0, n // 12 + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            x, y = setjoin.parity_sketch(a), setjoin.parity_sketch(b)
            w = min(len(x), len(y))
            assert np.bitwise_count(setjoin.folded(x, w) ^ setjoin.folded(y, w)).sum() <= len(a) + len(b) - 2 * both
            if den * both >= num * (len(a) + len(b) - both):
                key, owner = setjoin.sketch_keys([a, b], np.array([1, 2]), floors, num, den)
                assert set(key[owner == 1]) & set(key[owner == 2])
                linked += 1
    assert linked > 40


@pytest.mark.parametrize("step", [1, 2, 5, 200])
def test_bucket_stream_keeps_exactly_the_shared_keys(step):
    random.seed(5)
    rows = sorted((random.randint(0, 40), random.randint(0, 3)) for _ in range(150))
    want = sorted((k, n) for k, n in set(rows) if len({b for a, b in rows if a == k}) > 1)
    batches = (pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[i:i + step]]) for j in (0, 1)], ["key", "node"]) for i in range(0, len(rows), step))
    assert [x for b in setjoin._buckets(batches) for x in zip(b["key"].to_pylist(), b["node"].to_pylist())] == want


def test_boundaries_are_optimal():
    rng = np.random.default_rng(6)
    for n, k in ((1, 3), (4, 2), (7, 3), (8, 4)):
        top = np.sort(rng.choice(100, n, replace=False) + 1).astype(float)
        count = rng.integers(1, 9, n).astype(float)

        def padded(ends):
            return sum(c * min(e for e in ends if e >= t) for t, c in zip(top, count))
        best = min(padded((*x, top[-1])) for r in range(k) for x in itertools.combinations(top[:-1], r))
        assert padded(packing.boundaries(top, count, k)) == best
    assert packing.boundaries(np.zeros(0), np.zeros(0), 4) == []


def test_targets_stop_at_the_cap_and_share_the_excess():
    mix = mixing.Mix()
    assert mixing.targets([10, 1000, 1000], mix) == [20.0, (3015 - 20) / 3, 2 * (3015 - 20) / 3]
    assert mixing.targets([], mix) == [] and mixing.targets([0, 0], mix) == [0.0, 0.0]
    got = mixing.targets([5, 7, 900, 20, 31], mix)
    assert all(t <= 2 * s for t, s in zip(got, [5, 7, 900, 20, 31])) and abs(sum(got) - 1.5 * 963) < 1e-6


def test_splitting_tree_gives_exact_disjoint_quotas():
    draws = [37, 5, 0, 111]
    runs = mixing.shard_quotas(draws, 9, 1)
    assert runs == mixing.shard_quotas(draws, 9, 1)
    for s, n in enumerate(draws):
        own = sorted((a, b) for i, a, b, _ in runs if i == s)
        assert [x for a, b in own for x in range(a, b)] == list(range(n))
    size = [sum(b - a for _, a, b, sh in runs if sh == k) for k in range(9)]
    assert max(size) - min(size) <= 2 and sum(size) == sum(draws)


def make_file(n, compress):
    bodies = [f"<p>page {i}</p>".encode() * (i + 1) for i in range(n)]
    return [warc.record(i, f"http://h/{i}", b, base64.b32encode(hashlib.sha1(b).digest()).decode(), None, compress=compress) for i, b in enumerate(bodies)]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("damage", ["none", "flip", "cut", "junk", "head"])
def test_salvage_recovers_everything_outside_the_gap(compress, damage):
    parts = make_file(6, compress)
    lost = set()
    if damage == "flip":
        p = bytearray(parts[2])
        p[-7] ^= 0x55                                   # in the payload, or in the checksum of the member
        parts[2], lost = bytes(p), {2}
    elif damage == "cut":
        parts[5], lost = parts[5][:-9], {5}
    elif damage == "junk":
        parts.insert(3, b"\x1f\x8b\x08junk\nWARC/1.0 nonsense\r\n")
    elif damage == "head":
        parts[0], lost = parts[0][7:], {0}
    data = b"".join(parts)
    if damage == "head" and not compress:
        data = b"WARC/" + data                          # still a plain file, its first record is damaged
    seen = list(warc.salvage(memoryview(data)))
    assert {warc.page_id(x[3]["warc-record-id"]) for x in seen if x[0] == "record"} == set(range(6)) - lost
    assert [x[0] for x in seen].count("gap") == (damage != "none")
    edges = [(x[1], x[2]) for x in seen]
    assert edges[0][0] == 0 and edges[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))


def check_whole(data, found):
    seen = list(warc.salvage(memoryview(data)))
    assert [warc.page_id(x[3]["warc-record-id"]) for x in seen if x[0] == "record"] == found
    edges = [(x[1], x[2]) for x in seen]
    assert edges[0][0] == 0 and edges[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))


def test_salvage_of_a_plain_file_without_its_first_bytes():
    for cut in (1, 7, 40, 300):
        check_whole(b"".join(make_file(6, False))[cut:], [1, 2, 3, 4, 5])
    check_whole(b"\0" * 9 + b"".join(make_file(6, False))[9:], [1, 2, 3, 4, 5])
    check_whole(b"\x1f\x8b\x08" + b"".join(make_file(6, False))[3:], [1, 2, 3, 4, 5])


def test_salvage_goes_on_at_the_nearer_of_member_and_version_line():
    packed, plain = make_file(6, True), make_file(6, False)
    check_whole(packed[0] + b"junk" + packed[1] + b"junk\n" + plain[2] + plain[3] + packed[4], [0, 1, 2, 3, 4])


def test_plain_record_with_a_long_header():
    plain = make_file(3, False)
    plain[1] = plain[1].replace(b"WARC-Date", b"X-Long: " + b"x" * (3 << 20) + b"\r\nWARC-Date", 1)
    check_whole(b"".join(plain), [0, 1, 2])


def test_salvage_of_empty_and_alien_files():
    assert list(warc.salvage(memoryview(b""))) == []
    assert [x[:3] for x in warc.salvage(memoryview(b"hello"))] == [("gap", 0, 5)]


def test_page_ids_survive_the_record_id():
    for i in (0, 1, -5, 2**63 - 1, -2**63):
        assert warc.page_id(warc.record_id(i)) == i
    assert warc.page_id(None) is None and warc.page_id("<urn:uuid:zz>") is None
