"""Canonical length-limited Huffman code, packed and unpacked with arrays."""
import numpy as np

MOST_BITS = 18
SEGMENT = 256                                           # ids between two bit-offset checkpoints


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Optimal code lengths of at most `most` bits by package-merge; ids that never occur get 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(most):
        both = np.concatenate([weight, packages])
        place = np.argsort(both, kind="stable")
        levels.append(place < len(weight))
        both = both[place]
        packages = both[:len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    length, take = np.zeros(len(order), np.int64), 2 * len(order) - 2
    for leaf in reversed(levels):
        symbols = int(leaf[:take].sum())
        length[:symbols] += 1
        take = 2 * (take - symbols)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    code = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = (1 << (MOST_BITS - lengths[order].astype(np.int64)))
    first = np.concatenate([[0], np.cumsum(span)[:-1]])
    code[order] = first >> (MOST_BITS - lengths[order].astype(np.int64))
    return code


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) by the next MOST_BITS bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (MOST_BITS - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << MOST_BITS, np.uint32), np.zeros(1 << MOST_BITS, np.uint8)
    n = int(span.sum())
    ids[:n], size[:n] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, size


def encode(ids: np.ndarray, n_each: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bytes of each document, bits of each segment).  Documents start at whole bytes; a segment never spans documents."""
    size = lengths[ids].astype(np.int64)
    before = np.concatenate([[0], np.cumsum(size)])
    ends = np.concatenate([[0], np.cumsum(n_each)])
    bits = before[ends[1:]] - before[ends[:-1]]
    n_bytes = (bits + 7) // 8
    doc_at = np.concatenate([[0], np.cumsum(n_bytes)]) * 8
    at = before[:-1] + np.repeat(doc_at[:-1] - before[ends[:-1]], n_each)
    word, shift = at >> 5, at & 31
    wide = codes[ids].astype(np.uint64) << (np.uint64(64) - (size + shift).astype(np.uint64))
    n = int(doc_at[-1] // 32 + 2)
    high = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n) if len(ids) else np.zeros(n)
    low = np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n) if len(ids) else np.zeros(n)
    packed = (high + low).astype(np.uint64).astype(">u4").view(np.uint8)[:int(n_bytes.sum())]
    seg_n = -(-n_each // SEGMENT)
    first = np.repeat(ends[:-1], seg_n) + SEGMENT * (np.arange(int(seg_n.sum())) - np.repeat(np.cumsum(seg_n) - seg_n, seg_n))
    last = np.minimum(first + SEGMENT, np.repeat(ends[1:], seg_n))
    return packed, n_bytes, (before[last] - before[first]).astype(np.uint16)


def decode(payload: np.ndarray, n_each: np.ndarray, n_bytes: np.ndarray, seg_bits: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ids of all documents of a block: all segments are read side by side, one id a step."""
    seg_n = -(-n_each // SEGMENT)
    total = int(n_each.sum())
    if not total:
        return np.zeros(0, np.uint32)
    run = np.cumsum(seg_bits.astype(np.int64)) - seg_bits
    first_seg = np.cumsum(seg_n) - seg_n
    has = seg_n > 0
    doc_bit = np.where(has, 8 * (np.cumsum(n_bytes) - n_bytes) - run[np.minimum(first_seg, len(run) - 1)], 0)
    pos = run + np.repeat(doc_bit, seg_n)
    start = np.repeat(np.cumsum(n_each) - n_each, seg_n) + SEGMENT * (np.arange(len(pos)) - np.repeat(first_seg, seg_n))
    count = np.minimum(SEGMENT, np.repeat(np.cumsum(n_each), seg_n) - start)
    order = np.argsort(-count, kind="stable")
    pos, start, count = pos[order], start[order], count[order]
    raw = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.empty(total, np.uint32)
    active = np.searchsorted(-count, -np.arange(1, int(count[0]) + 1), "right")
    for step, n in enumerate(active):
        p = pos[:n]
        # 32 bits from the byte of the position hold MOST_BITS bits after up to 7 bits
        look = (window[p >> 3] >> (32 - MOST_BITS - (p & 7)).astype(np.uint32)) & np.uint32((1 << MOST_BITS) - 1)
        out[start[:n] + step] = ids[look]
        pos[:n] = p + size[look]
    return out
