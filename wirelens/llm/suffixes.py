"""Suffix arrays by induced sorting, vectorised.

Suffixes are classified as larger or smaller than their successor; the leftmost-smaller (LMS) substrings are sorted
and named, the string of names is sorted by recursion, and from the sorted LMS suffixes the others are induced. Over
bytes, the two linear passes go through the buckets by first byte and handle a whole bucket with array operations:
what a bucket induces into itself (runs of one byte) follows generation by generation, as in a scan. Over names, of
which there are too many for a loop over buckets, a pass induces all runs at once: larger suffixes from the LMS suffix
that ends their run, then smaller ones from the larger suffix that ends theirs.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than the next one; text ends with a unique smallest symbol."""
    change = np.flatnonzero(text[:-1] != text[1:])
    rising = text[change] < text[change + 1]
    out = np.repeat(rising, np.diff(np.concatenate([[-1], change])))
    return np.append(out, True)


def _spread(place: np.ndarray, head: np.ndarray, symbols: np.ndarray, entries: np.ndarray, step: int) -> None:
    """Appends entries, in order, to the buckets of their symbols; head holds each bucket's next place."""
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols, minlength=len(head))
    sorted_symbols = symbols[order]
    rank = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    place[head[sorted_symbols] + step * rank] = entries[order]
    head += step * counts


def induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array, given the LMS suffixes in order (or only sorted by their first symbol)."""
    counts = np.bincount(text, minlength=size)
    end = np.cumsum(counts)
    begin = end - counts
    larger_counts = np.bincount(text[~smaller], minlength=size)
    place = np.full(len(text), -1, np.int32 if len(text) < 1 << 31 else np.int64)
    lms_symbols = text[lms]
    lms_end = np.searchsorted(lms_symbols, np.arange(size), side="right")
    lms_begin = np.searchsorted(lms_symbols, np.arange(size), side="left")
    head = begin.copy()
    for c in range(size):
        if not counts[c]:
            continue
        done = begin[c]
        while done < head[c]:  # what the bucket got, generation by generation
            now = place[done : head[c]]
            done = head[c]
            before = now[now > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _spread(place, head, text[before], before, 1)
        now = lms[lms_begin[c] : lms_end[c]]
        before = now[now > 0] - 1
        if len(before):
            _spread(place, head, text[before], before, 1)
    tail = end - 1
    for c in range(size - 1, -1, -1):
        if not counts[c]:
            continue
        done = end[c] - 1
        while done > tail[c]:
            now = place[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            before = now[now > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _spread(place, tail, text[before], before, -1)
        now = place[begin[c] : begin[c] + larger_counts[c]][::-1]
        before = now[now > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _spread(place, tail, text[before], before, -1)
    place[0] = len(text) - 1  # the end symbol
    return place


def _names(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings (by text order), equal for equal substrings; order: LMS positions as sorted."""
    index = np.full(len(text), -1, np.int64)
    index[lms] = np.arange(len(lms))
    length = np.append(np.diff(lms), 0) + 1
    sorted_index = index[order]
    left, right = order[:-1], order[1:]
    size = length[sorted_index]
    same = size[:-1] == size[1:]
    alive = np.flatnonzero(same)
    k = 0
    while len(alive):
        equal = text[left[alive] + k] == text[right[alive] + k]
        same[alive[~equal]] = False
        k += 1
        alive = alive[equal]
        alive = alive[size[alive] > k]
    name = np.empty(len(lms), np.int64)
    name[sorted_index] = np.concatenate([[0], np.cumsum(~same)])
    return name


def _places(key: np.ndarray) -> np.ndarray:
    """For each number, how many are smaller."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(new, np.diff(np.append(new, len(key))))
    return out


def _split(place: np.ndarray, open_: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Splits the ties of place among open_ (whole ties) by the numbers `by`; gives those that still tie."""
    if not len(open_):
        return open_
    pair = place[open_] * (len(place) + 1) + by
    order = np.argsort(pair)
    open_, pair = open_[order], pair[order]
    before = place[open_]
    first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
    at = before + np.arange(len(open_)) - np.repeat(first, np.diff(np.append(first, len(open_))))
    new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    size = np.diff(np.append(new, len(open_)))
    place[open_] = np.repeat(at[new], size)
    return open_[np.repeat(size, size) > 1]


def _ties(place: np.ndarray, among: np.ndarray) -> np.ndarray:
    return np.flatnonzero((np.bincount(place, minlength=len(place))[place] > 1) & among)


def induce_runs(code: np.ndarray, stop: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Ranks (places, ties equal) of all positions: by the codes up to the next stop, then by that stop's rank.

    No stop has the code of another position, and the last position is a stop or has a code of its own.
    """
    n = len(code)
    end = np.minimum.accumulate(np.where(stop, np.arange(n), n - 1)[::-1])[::-1]
    place = _places(code * (n + 1) + np.where(stop, rank, 0))
    open_, step = _ties(place, ~stop), 1
    while len(open_):
        open_ = _split(place, open_, place[np.minimum(open_ + step, end[open_])])
        step *= 2
        open_ = open_[open_ + step <= end[open_]]  # ties are of runs of one length, if these have ended
    return place


def suffix_ranks(names: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of a string of numbers, right for `depth` numbers at least (ties equal); its last is the smallest."""
    place = _places(names)
    if depth <= 1 or not len(_ties(place, np.ones(len(names), bool))):
        return place
    smaller = classify(names)
    code = 2 * names + smaller
    # All codes up to the next LMS position: larger runs first, then smaller ones before a larger one.
    place = induce_runs(code, ~smaller, induce_runs(code, smaller, np.zeros(len(names), np.int64)))
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    # LMS positions are two apart at least, so half as many names reach the depth.
    rank = suffix_ranks(_places(place[lms]), (depth + 1) // 2)
    open_ = _ties(place, np.ones(len(names), bool))
    _split(place, open_, rank[np.searchsorted(lms, open_, side="right")])
    return place


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of data (bytes) in the order of their suffixes, which is right for the first `depth` bytes."""
    if not len(data):
        return np.zeros(0, np.int64)
    text = np.append(data.astype(np.int16) + 1, 0).astype(np.int16)  # 16 bits are sorted by radix
    smaller = classify(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    first = lms[np.argsort(text[lms], kind="stable")]
    once = induce(text, smaller, first, 257)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    order = once[is_lms[once]]
    ranked = np.argsort(suffix_ranks(_names(text, lms, order), (depth + 1) // 2), kind="stable")
    return induce(text, smaller, lms[ranked], 257)[1:]


def words_at(data: np.ndarray, beyond: int = 0) -> np.ndarray:
    """The eight bytes from each position on as one number (zeros beyond the end), and `beyond` zeros."""
    padded = np.concatenate([data, np.zeros(8 + beyond, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(data) + beyond, 8), (1, 1)).copy().view(np.uint64).ravel()


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Permuted longest common prefixes, up to `depth`: by position, with the suffix before it in order (all suffixes, or some)."""
    out = np.zeros(len(data), np.int32)
    if len(order) < 2:
        return out
    before = np.zeros(len(data), order.dtype)
    before[order[1:]] = order[:-1]
    here = np.zeros(len(data), bool)
    here[order[1:]] = True
    every = np.flatnonzero(here).astype(order.dtype)
    before = before[every]
    words = words_at(data, depth + 8)
    at, other = every, before
    for k in range(0, depth, 8):
        differ = words[k:][at] ^ words[k:][other]
        equal = differ == 0
        low = differ[~equal]
        # Low bytes come first: the zero bits below the lowest difference, in bytes.
        out[at[~equal]] = k + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> 3)
        at, other = at[equal], other[equal]
    out[at] = depth
    # Zeros beyond the end agree with nothing.
    out[every] = np.minimum(np.minimum(out[every], depth), len(data) - np.maximum(before, every))
    return out
