"""Word shingles of many texts at once, as sorted 64-bit hashes."""
import numpy as np

BYTES = 1 << 22
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of a buffer; white space is byte 32 and bytes 9 to 13."""
    a = np.frombuffer(buffer, np.uint8)
    inside = ~((a == 32) | ((a >= 9) & (a <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, size = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return start, np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    power = np.full(int(size.max()), _ODD[0])
    power[0] = 1
    power = np.multiply.accumulate(power)
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    return start, mix(np.add.reduceat((a[inside].astype(np.uint64) + np.uint64(1)) * power[place], first) + size.astype(np.uint64) * _ODD[1])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words up to each text); A to Z are lower-cased, bytes are walked in stretches that end at white space."""
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    whole = b"\n".join(raw) + b"\n"
    at, starts, hashes = 0, [], []
    while at < len(whole):
        end = at + BYTES
        if end < len(whole):
            cut = [p for p in (whole.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if p >= 0]
            end = min(cut) + 1
        s, h = _word_hashes(whole[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), ends, "left")


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer than k words the whole sequence is one; without words the set is empty."""
    word, upto = word_hashes(texts)
    begin = np.concatenate([[0], upto[:-1]])
    padded = np.concatenate([word, np.zeros(k, np.uint64)])
    run = np.zeros(len(word), np.uint64)
    for j in range(k):
        run += padded[j:j + len(word)] * _ODD[j]
    run = mix(run)
    out = []
    for b, e in zip(begin, upto):
        n = e - b
        if n >= k:
            out.append(np.unique(run[b:e - k + 1]))
        elif n:
            out.append(mix((word[b:e] * _ODD[:n]).sum(keepdims=True, dtype=np.uint64) + np.array([n], np.uint64) * _ODD[7]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(h: np.ndarray) -> int:
    """Order-free 64-bit hash of a set, as a signed integer."""
    return int(mix(mix(h ^ _ODD[5]).sum(keepdims=True, dtype=np.uint64) + np.array([len(h)], np.uint64) * _ODD[6]).view(np.int64)[0]) if len(h) else 0
