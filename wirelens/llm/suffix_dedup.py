"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller doc_id.

Texts are packed into blocks of some megabytes on shared storage. Every 50-byte window has an anchor, its smallest
12-byte gram (by a hash), and a key: the anchor with 19 bytes to its left, or to its right where the window doesn't reach
as far. Equal windows have equal anchors and keys. Three exchanges carry what is needed and no texts:

1. Each block sends the hashes of its keys, to tasks by hash, and learns which occur in more than one document.
2. For the anchors of these it sends the context (the bytes of the windows with such keys) with the smallest doc_id that
   has it in the block; equal contexts go once, dealt to shards by the anchor. A shard splits its contexts by anchors into
   piles of bounded size, and builds a pile's suffix array by induced sorting and the permuted common prefixes; a run of
   suffixes that agree on 50 bytes is one string, and the smallest doc_id of the run is where it comes from. As equal
   windows have equal anchors, all places of a string meet in one pile.
3. Each block gets back, for its contexts, the smallest doc_id of each window, and cuts its documents.

Hashes only choose what meets; what is removed is decided by comparing bytes in the suffix array.

What is sent is dealt to as many tasks as the table's size asks for, so that a task's share stays the same as the table grows.

Edge cases: a null text is empty; texts under 50 bytes lose nothing. A null doc_id comes after all others, and null ones
don't take from each other; rows that share a doc_id don't either. Any long is a doc_id. A text longer than a block is a
block of its own, and takes some 30 bytes of memory a byte. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, read_table
from .shingles import mixed
from .suffixes import common_prefixes, suffix_array

SPAN = 50
GRAM = 12
SIDE = (SPAN - GRAM) // 2
REACH = SPAN - GRAM + 1
BLOCK_BYTES = 4 << 20
#: Bytes of texts for each bucket of keys, and for each shard of contexts: a task of its exchange, about.
BUCKET_TEXT = 32 << 20
SHARD_TEXT = 8 << 20
#: Bytes of contexts that are sorted at once.
SORTED_BYTES = 1 << 20
#: Blocks are written in row groups of few of them: a reader holds a whole row group.
ROW_GROUPS = {"parquet.block.row.count.limit": 2, "parquet.page.row.count.limit": 1}
#: Bytes of masks that may be broadcast.
BROADCAST_BYTES = 32 << 20
FIRST, LAST = -(1 << 63), (1 << 63) - 1

_random = np.random.RandomState(50)
_BYTE = (_random.randint(1, 1 << 62, 256).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SLICE = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(base))]), dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, SLICE + 4 * SPAN), _powers(_INVERSE, SLICE + 4 * SPAN)


class Anchors:
    """The anchors of a block: for each, its hash, its place, its first window and their number, and its document.

    keys are what its windows have in common: those that reach SIDE bytes to its left share the bytes from there to the
    gram's end, the others the gram and SIDE bytes to its right. owner is the anchor of each key, the `lefts` first ones
    are for windows on the left.
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        ends = np.cumsum(lengths)
        begin, over = ends - lengths, np.maximum(ends - SPAN + 1, ends - lengths)
        bounds = np.union1d(begin, over)
        windows = max(0, len(data) - SPAN + 1)
        parts = [self._slice(data, low, min(low + SLICE, windows), bounds, ends, over) for low in range(0, windows, SLICE)]
        none = (*[np.zeros(0, np.int64)] * 4, *[np.zeros(0, np.uint64)] * 3)
        self.start, self.count, self.place, self.doc, self.hash, left, right = (np.concatenate(x) for x in zip(none, *parts, strict=True))
        self.middle = self.place - SIDE  # the last window that reaches SIDE bytes to the left
        on_left, on_right = np.flatnonzero(self.start <= self.middle), np.flatnonzero(self.start + self.count - 1 > self.middle)
        self.keys, self.owner, self.lefts = np.concatenate([left[on_left], right[on_right]]), np.concatenate([on_left, on_right]), len(on_left)

    @staticmethod
    def _slice(data: np.ndarray, low: int, high: int, bounds: np.ndarray, ends: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, ...]:
        """The anchors of the windows that start at low .. high - 1."""
        part = data[low : high + SPAN - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _UP[: len(part)], dtype=np.uint64, out=sums[1:])
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(part) - GRAM + 1])
        places = np.arange(len(grams), dtype=np.uint64)
        key = (grams & ~np.uint64(0xFFFFF)) | places  # the first of equal ones
        width = 1
        while 2 * width <= REACH:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        rest = REACH - width
        if rest:
            key = np.minimum(key[:-rest], key[rest:])
        # Windows of one document with one anchor are a run; a document's first and last windows bound its runs.
        cut = np.ones(high - low, bool)
        cut[1:] = key[1:] != key[:-1]
        cut[bounds[slice(*np.searchsorted(bounds, [low, high]))] - low] = True
        edge = np.flatnonzero(cut)
        doc = np.searchsorted(ends, edge + low, side="right")
        own = edge + low < over[doc]
        start, count, doc = edge[own], np.diff(np.append(edge, high - low))[own], doc[own]
        place = (key[start] & np.uint64(0xFFFFF)).astype(np.int64)
        before = np.maximum(place - SIDE, 0)
        left = mixed((sums[place + GRAM] - sums[before]) * _DOWN[before] + np.uint64(SIDE))
        after = np.minimum(place + GRAM + SIDE, len(part))
        right = mixed((sums[after] - sums[place]) * _DOWN[place])
        return start + low, count, place + low, doc, grams[place], left, right


def context_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the bytes data[start : start + size] for each context, given in order of start."""
    out = np.empty(len(start), np.uint64)
    low = 0
    while low < len(start):
        base = int(start[low])
        high = int(np.searchsorted(start, base + SLICE))
        s, e = start[low:high] - base, start[low:high] - base + size[low:high]
        part = data[base : base + int(e.max())]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[part] * _UP[: len(part)], dtype=np.uint64)])
        out[low:high] = (sums[e] - sums[s]) * _DOWN[s]
        low = high
    return mixed(out + size.astype(np.uint64))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. , one after another."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


class Block:
    def __init__(self, row: dict):
        self.ids, self.lengths, self.data = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["data"], np.uint8)
        self.anchors = Anchors(self.data, self.lengths)

    def by_bucket(self, buckets: int):
        """Per bucket: the sorted distinct keys, whether more than one document here has each, and whose they are."""
        a = self.anchors
        order = np.argsort(a.keys)
        h, d = a.keys[order], self.ids[a.doc[a.owner[order]]]
        if not len(h):
            return
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        several = np.maximum.reduceat(d, first) != np.minimum.reduceat(d, first)
        group = np.cumsum(new) - 1
        bucket = _dealt(h[first], buckets)  # in order, as the keys are
        low = 0
        for high in np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(first)).tolist():
            mine = slice(first[low], first[high] if high < len(first) else len(h))
            yield int(bucket[low]), h[first[low:high]], several[low:high], order[mine], group[mine] - low
            low = high

    def shared(self, buckets: int, masks: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchors that have windows whose key occurs in more than one document: which, and their first such window and number."""
        a = self.anchors
        found = np.zeros(len(a.keys), bool)
        for k, hashes, _, mine, group in self.by_bucket(buckets):
            if k in masks:
                found[mine] = np.unpackbits(masks[k], count=len(hashes)).astype(bool)[group]
        left, right = np.zeros(len(a.start), bool), np.zeros(len(a.start), bool)
        left[a.owner[: a.lefts]], right[a.owner[a.lefts :]] = found[: a.lefts], found[a.lefts :]
        end = a.start + a.count
        first, beyond = np.where(left, a.start, np.maximum(a.start, a.middle + 1)), np.where(right, end, np.minimum(end, a.middle + 1))
        at = np.flatnonzero(left | right)
        return at, first[at], (beyond - first)[at]

    def contexts(self, shards: int, at: np.ndarray, start: np.ndarray, count: np.ndarray):
        """Per shard: the distinct contexts (pile, start, size, smallest id), and which of the given anchors they are of."""
        if not len(at):
            return
        a, size = self.anchors, count + SPAN - 1
        deal = mixed(a.hash[at])
        shard, pile = _dealt(deal, shards), (deal & np.uint64(0xFF)).astype(np.uint8)
        same = context_hashes(self.data, start, size) ^ deal
        order = np.argsort(same)
        order = order[np.argsort(shard[order], kind="stable")]
        of, same = shard[order], same[order]
        new = np.ones(len(order), bool)
        new[1:] = (same[1:] != same[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(self.ids[a.doc[at[order]]], first)
        group, one = np.cumsum(new) - 1, order[first]
        of_first = of[first]
        low = 0
        for high in np.append(np.flatnonzero(of_first[1:] != of_first[:-1]) + 1, len(first)).tolist():
            mine = slice(first[low], first[high] if high < len(first) else len(order))
            few = one[low:high]
            yield int(of_first[low]), pile[few], start[few], size[few], least[low:high], order[mine], group[mine] - low
            low = high


def _dealt(hashes: np.ndarray, n: int) -> np.ndarray:
    """A number below n for each hash, by its upper bits and in its order."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row, without copies: binary values as buffers; lists of structs as lists of dicts."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: _plain(batch.column(name)[k]) for name in batch.schema.names}


def _plain(value):
    if isinstance(value, pa.ListScalar):
        return [{k: _plain(v) for k, v in item.items()} for item in value.values or []]
    return value.as_buffer() if isinstance(value, pa.BinaryScalar) else value.as_py()


def _values(column: pa.ChunkedArray, kind: type | str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def unused_id(docs: DataFrame) -> int:
    """A long that isn't a doc_id of docs: the ids above it are numbered one lower inside, and LAST is free for null ones."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()  # two numbers
    if high is None or high < LAST:
        return LAST
    hole = FIRST
    while hole == low or hole != FIRST and docs.where(F.col("doc_id") == hole).limit(1).count():
        hole = int(_random.randint(-(1 << 62), 1 << 62))
    return hole


def pack(docs: DataFrame, work: Work, hole: int = LAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, ids, lengths, data: documents packed into blocks of about block_bytes, or one document if that is longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, texts, size, n = [], [], [], 0, 0
        part = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            row = (part << 32 | n, np.concatenate(ids).tobytes(), np.concatenate(lengths).tobytes(), b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), *[pa.binary()] * 3), strict=True)], ["block", "ids", "lengths", "data"])

        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            end = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            given, low = batch.column("id").to_numpy(), 0
            while low < len(text):
                high = min(len(text), low + 1 + int(np.searchsorted(end[low + 1 :] - end[low], block_bytes - size)))
                ids.append(given[low:high])
                lengths.append(np.diff(end[low : high + 1]))
                if end[high] > end[low]:
                    texts.append(text.buffers()[2][end[low] : end[high]].to_pybytes())
                size, low = size + int(end[high] - end[low]), high
                if size >= block_bytes:
                    yield block()
                    ids, lengths, texts, size, n = [], [], [], 0, n + 1
        if ids:
            yield block()

    inner = F.when(F.col("doc_id").isNull(), F.lit(LAST)).when(F.col("doc_id") > hole, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    packed = docs.select(inner.alias("id"), "text").mapInArrow(run, "block long, ids binary, lengths binary, data binary")
    return work.save(packed, "blocks", "zstd", ROW_GROUPS)


def _offers(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            rows = [(k, r["block"], (h & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), np.packbits(several).tobytes()) for k, h, several, _, _ in Block(r).by_bucket(buckets)]
            yield _batch(rows, {"bucket": pa.int64(), "block": pa.int64(), "hashes": pa.binary(), "several": pa.binary()})

    return run


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))


def _answers(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block, which of its hashes are shared."""
    hashes = _values(table["hashes"], "<u4")
    several = [np.unpackbits(b, count=len(h)) for b, h in zip(_values(table["several"], np.uint8), hashes, strict=True)]
    every = np.concatenate(hashes)
    order = np.argsort(every)
    ranked = every[order]
    new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.append(new, len(ranked)))
    often = (size > 1) | (np.maximum.reduceat(np.concatenate(several)[order], new) > 0)
    out = np.empty(len(every), bool)
    out[order] = np.repeat(often, size)
    cuts = np.cumsum([len(h) for h in hashes])[:-1]
    masks = pa.array([np.packbits(m).tobytes() for m in np.split(out, cuts)], pa.binary())
    return pa.table({"bucket": table["bucket"], "block": table["block"], "mask": masks})


def _masks(row: dict) -> dict[int, np.ndarray]:
    return {m["bucket"]: np.frombuffer(m["mask"], np.uint8) for m in row["masks"] or []}


def _contexts(buckets: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            b = Block(r)
            rows = [
                (k, r["block"], size.astype("<u2").tobytes(), pile.tobytes(), least.tobytes(), b.data[ranges(start, size)].tobytes())
                for k, pile, start, size, least, _, _ in b.contexts(shards, *b.shared(buckets, _masks(r)))
            ]
            yield _batch(rows, {"shard": pa.int64(), "block": pa.int64()} | dict.fromkeys(("sizes", "piles", "least", "data"), pa.binary()))

    return run


def window_sources(data: np.ndarray, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The smallest id of each window's string over all contexts (laid end to end in data), in order of the windows."""
    # Contexts that are equal byte for byte stand for each other; each of them is sorted once.
    start = np.cumsum(size) - size
    same = context_hashes(data, start, size)
    order = np.lexsort((size, same))
    new = np.ones(len(order), bool)
    new[1:] = (same[order][1:] != same[order][:-1]) | (size[order][1:] != size[order][:-1])
    twin = np.empty(len(size), np.int64)
    twin[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    others = np.flatnonzero(twin != np.arange(len(size)))
    differ = data[ranges(start[others], size[others])] != data[ranges(start[twin[others]], size[others])]
    if differ.any():  # of one hash, but not equal: each stands for itself
        apart = others[np.add.reduceat(differ, np.cumsum(size[others]) - size[others]) > 0]
        twin[apart] = apart
    keep, twin = np.unique(twin, return_inverse=True)
    smallest = np.full(len(keep), np.iinfo(least.dtype).max, least.dtype)
    np.minimum.at(smallest, twin, least)
    n = size[keep]
    # Each context is followed by a byte that no UTF-8 text has, so no window reaches over its end.
    flat = np.full(int(n.sum()) + len(n), 255, np.uint8)
    at = np.cumsum(n + 1) - (n + 1)
    flat[ranges(at, n)] = data[ranges(start[keep], n)]
    windows = n - SPAN + 1
    first = np.full(len(flat), False)
    first[ranges(at, windows)] = True
    suffixes = suffix_array(flat, SPAN)
    suffixes = suffixes[first[suffixes]]  # all others reach a context's end, and agree with no window
    agree = common_prefixes(flat, suffixes, SPAN)[suffixes] >= SPAN
    run = np.flatnonzero(~agree)
    owner = np.repeat(smallest, n + 1)[suffixes]
    source = np.empty(len(flat), least.dtype)
    source[suffixes] = np.repeat(np.minimum.reduceat(owner, run), np.diff(np.append(run, len(suffixes))))
    return source[ranges(at[twin], size - SPAN + 1)]


def _sources(table: pa.Table) -> pa.Table:
    """Of one shard: for each block, runs (length, smallest id) over the windows of its contexts.

    Anchors are dealt to piles by their hashes, as many as the bytes ask for: suffix arrays are of SORTED_BYTES, about,
    whatever part of the texts is shared.
    """
    sizes = _values(table["sizes"], "<u2")
    size, pile = np.concatenate(sizes).astype(np.int64), np.concatenate(_values(table["piles"], np.uint8))
    ids, least = np.unique(np.concatenate(_values(table["least"], np.int64)), return_inverse=True)
    least = least.astype(np.int32)
    data = np.concatenate(_values(table["data"], np.uint8))
    piles = min(256, 1 + len(data) // SORTED_BYTES)
    pile = pile.astype(np.int64) * piles >> 8
    start, windows = np.cumsum(size) - size, size - SPAN + 1
    first = np.cumsum(windows) - windows
    found = np.empty(int(windows.sum()), np.int32)
    for k in range(piles):
        mine = np.flatnonzero(pile == k)
        if len(mine):
            found[ranges(first[mine], windows[mine])] = window_sources(data[ranges(start[mine], size[mine])], size[mine], least[mine])
    counts, values = [], []
    low, total = 0, np.cumsum(windows)
    for last in np.cumsum([len(s) for s in sizes]).tolist():
        part = found[low : total[last - 1]]
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        counts.append(np.diff(np.append(edge, len(part))).astype("<u4").tobytes())
        values.append(ids[part[edge]].tobytes())
        low = total[last - 1]
    return pa.table({"shard": table["shard"], "block": table["block"], "counts": pa.array(counts, pa.binary()), "sources": pa.array(values, pa.binary())})


def _cut(buckets: int, shards: int, hole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            b = Block(r)
            got = {s["shard"]: s for s in r["answers"] or []}
            lost = np.zeros(len(b.data) + SPAN, np.int32)  # the windows that go, at their first bytes, after SPAN zeros
            at, start, count = b.shared(buckets, _masks(r))
            for k, _, _, size, _, mine, group in b.contexts(shards, at, start, count):
                answer = got[k]
                source = np.repeat(np.frombuffer(answer["sources"], np.int64), np.frombuffer(answer["counts"], "<u4"))
                windows = size - SPAN + 1
                first = np.cumsum(windows) - windows
                n = windows[group]
                hit = source[ranges(first[group], n)] < np.repeat(b.ids[b.anchors.doc[at[mine]]], n)
                lost[ranges(start[mine], n)[hit] + SPAN] = 1
            np.cumsum(lost, out=lost)
            gone = lost[SPAN:] > lost[:-SPAN]
            del lost
            ends = np.cumsum(b.lengths)
            begin = ends - b.lengths
            edge = gone.copy()  # the first byte of each span
            edge[1:] &= ~gone[:-1]
            starts = begin[b.lengths > 0]
            edge[starts] = gone[starts]
            removed, spans = (np.concatenate([np.zeros(1, np.int32), np.cumsum(x, dtype=np.int32)]) for x in (gone, edge))
            kept = b.data[~gone]
            place = np.append(begin - removed[begin], len(kept)).astype(np.int32)
            digests = [hashlib.sha256(kept[low:high]).hexdigest() for low, high in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
            columns = {
                "doc_id": pa.array(b.ids + (b.ids >= hole), mask=b.ids == LAST),
                "n_bytes": pa.array(b.lengths),
                "n_removed": pa.array((removed[ends] - removed[begin]).astype(np.int64)),
                "n_spans": pa.array((spans[ends] - spans[begin]).astype(np.int64)),
                "kept_sha256": pa.array(digests, pa.string()),
                "kept": pa.BinaryArray.from_buffers(pa.binary(), len(b.ids), [None, pa.py_buffer(place), pa.py_buffer(kept)]),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def dedup_suffixes(docs: DataFrame, work: Work) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that are left) for every row of docs."""
    hole = unused_id(docs)
    blocks = pack(docs, work, hole)
    total = blocks.agg(F.sum(F.length("data"))).first()[0] or 0  # one number
    buckets, shards, tasks = max(4, total // BUCKET_TEXT), max(4, total // SHARD_TEXT), max(4, total // BLOCK_BYTES)
    offers = blocks.mapInArrow(_offers(buckets), "bucket long, block long, hashes binary, several binary").repartition(max(4, shards // 2), "bucket")
    masks = work.save(offers.groupBy("bucket").applyInArrow(_answers, "bucket long, block long, mask binary"), "masks")
    per_block = masks.repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "mask")).alias("masks"))
    # About a bit for every thirteen bytes of text: broadcast while a check says that it is small, else joined by a shuffle.
    if (masks.agg(F.sum(F.length("mask"))).first()[0] or 0) <= BROADCAST_BYTES:
        per_block = F.broadcast(per_block)
    marked = blocks.join(per_block, "block", "left").select("block", "ids", "lengths", "data", "masks")
    sent = marked.mapInArrow(_contexts(buckets, shards), "shard long, block long, sizes binary, piles binary, least binary, data binary").repartition(shards, "shard")
    sources = work.save(sent.groupBy("shard").applyInArrow(_sources, "shard long, block long, counts binary, sources binary"), "sources")
    replies = sources.repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("shard", "counts", "sources")).alias("answers"))
    whole = blocks.repartition(tasks, "block").join(per_block, "block", "left").join(replies, "block", "left").select("block", "ids", "lengths", "data", "masks", "answers")
    return whole.mapInArrow(_cut(buckets, shards, hole), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(read_table(spark, sf_dir, "documents"), Work(spark)).drop("kept")
