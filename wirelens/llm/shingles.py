"""Word and shingle hashes of whole texts, vectorised over bytes.

Words are runs of bytes outside `[\\x20\\x09-\\x0D]` after lower-casing A-Z; a shingle is `size` consecutive words.
A text of any length is hashed slice by slice, so that memory follows a slice and eight bytes a word.
"""

from __future__ import annotations

import numpy as np

SLICE = 1 << 19
_rng = np.random.RandomState(20240229)
_BYTE = _rng.randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE[_SPACES] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, _BASE, np.uint64)]), dtype=np.uint64)
    return _powers


def _slice_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of one slice."""
    space = _SPACES[buf]
    solid = ~space
    first = solid.copy()
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    inside = np.arange(len(buf)) - np.repeat(starts, np.diff(np.append(starts, len(buf)))) if starts[0] == 0 else None
    if inside is None:
        buf, solid = buf[starts[0] :], solid[starts[0] :]
        moved = starts - starts[0]
        inside = np.arange(len(buf)) - np.repeat(moved, np.diff(np.append(moved, len(buf))))
    else:
        moved = starts
    lengths = np.add.reduceat(solid, moved).astype(np.int64)
    inside[~solid] = 0
    sums = np.add.reduceat(_BYTE[buf] * _power(int(lengths.max()) + 1)[inside], moved)
    return mixed(sums + lengths.astype(np.uint64)), starts


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of one text, in order."""
    data = data.lower()  # of bytes: A-Z only
    if len(data) <= SLICE:
        return _slice_hashes(np.frombuffer(data, np.uint8))[0]
    parts, at = [], 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and not _SPACES[data[end]]:
            end += 1
        parts.append(_slice_hashes(np.frombuffer(data[at:end], np.uint8))[0])
        at = end
    return np.concatenate(parts)


def batch_word_hashes(texts) -> list[np.ndarray]:
    """word_hashes for many texts (None counts as empty); short texts are hashed together."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    group: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        if not group:
            return
        lengths = np.array([len(b) + 1 for _, b in group])
        hashes, starts = _slice_hashes(np.frombuffer(b" ".join(b for _, b in group).lower() + b" ", np.uint8))
        cuts = np.searchsorted(starts, np.cumsum(lengths))
        low = 0
        for (i, _), high in zip(group, cuts.tolist(), strict=True):
            out[i] = hashes[low:high]
            low = high
        group.clear()

    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        if len(data) > SLICE // 4:
            out[i] = word_hashes(data)
            continue
        if size + len(data) > SLICE:
            flush()
            size = 0
        group.append((i, data))
        size += len(data) + 1
    flush()
    return out


_FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles_of(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all shingles in order; a text of fewer words is one shingle, one without words has none."""
    n = len(words)
    if not n:
        return words
    width = min(n, size)
    total = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        total += words[j : n - width + 1 + j] * _FACTORS[j]
    return mixed(total + np.uint64(width))
