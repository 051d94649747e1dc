"""Benchmark decontamination: random-walk embedding, bit-sampling LSH and exact edit verification.

A document leaks an item when some stretch of its words is within an edit distance (in words, case and
punctuation aside) of MAX_EDIT of the item's words. Three steps in one map-only pass:

1. Windows of the item's size (LONGEST at most) at every word of every text. A window can only hold the item if
   enough of its word pairs are those of items of that size (an edit spoils two pairs at most); windows with fewer are
   left out, which loses nothing.
2. The other windows are embedded by CGK random walks: at each step the current word is put out, and a random
   bit of (walk, step, word) says whether to go on to the next word. Texts at a small edit distance get
   embeddings at a small Hamming distance. Each of WALKS walks is sampled by TABLES sets of DRAWS positions; a
   window that agrees with an item's own embedding on one set is a candidate. Items are entered by their
   first and by their last words, so that edits at one end are caught from the other, and longer ones by every stretch
   of the window's size: wherever the edits are, one of the stretches has no more than its share of them.
3. Candidates are verified by the exact edit distance of the item to the best stretch nearby (bit-parallel).

The benchmark is read in blocks of ITEM_BLOCK stretches of its items, about 4 kB each, whose index goes to every task;
each block is a pass over the texts. Nothing is shuffled. Walks, tables and steps follow from TARGET_RECALL.

Items of fewer than MIN_WORDS words need no windows: an edit (five words allow one) leaves the first or the last pair
of words whole, so each place of one of these is a candidate; an item of one word is looked up itself.

Edge cases: null items and those without a word are left out; null and empty
texts leak nothing. A repeated document row repeats its hits; repeated items each have their own. Extra columns
are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, word_count
from .shingles import batch_word_hashes, mixed

MAX_EDIT = 0.2
MIN_WORDS = 6
#: The share of leaks to be found at MAX_EDIT, whatever the kind of edit. Walks, tables and steps are chosen by it:
#: tests/llm/test_others.py measures them.
TARGET_RECALL = 0.99
WALKS = 16
TABLES = 20
#: Steps of a walk, times the window's size: a walk has two steps a word on average.
STEPS = 2
DRAWS = 4
ITEM_BLOCK = 20_000
PAIR_BITS = 22
#: Keys are looked up in a table of their first bits before they are searched for.
KEY_BITS = 22
#: Windows that are embedded at once, by all walks.
AT_ONCE = 1 << 11
#: Words that are searched at once.
BATCH_WORDS = 1 << 18
GRID = [6, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 56, 64]
#: Longer items are searched by stretches of this size.
LONGEST = GRID[-1]

_PLAIN = bytes(ord(" ") if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


def normalised(text: str | None) -> str:
    """The text with ASCII punctuation as spaces; words are lower-cased when hashed."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).decode("utf-8", "surrogatepass")


def allowed_edits(words: int, rate: float = MAX_EDIT) -> int:
    return int(words * rate)


def step_bits(words: np.ndarray, walk: int, part: int) -> np.ndarray:
    """64 random bits of (walk, word) for 64 steps of the walk."""
    return mixed(words + np.uint64(((walk * 8 + part + 1) * 0x632BE59BD9B4E019) & (2**64 - 1)))


def embed(words: np.ndarray, at: np.ndarray, size: int, cache: dict) -> np.ndarray:
    """The first steps of the embeddings of the windows words[at : at + size], as positions x walks x windows."""
    steps = STEPS * size
    out = np.empty((steps, WALKS, len(at)), np.uint64)
    here = np.tile(at, (WALKS, 1))
    walk = np.arange(WALKS)[:, None]
    for step in range(steps):
        if step % 64 == 0:
            if step // 64 not in cache:
                cache[step // 64] = np.stack([step_bits(words, w, step // 64) for w in range(WALKS)])
            bits = cache[step // 64]
        if step < size:  # no walk can be over yet
            out[step] = words[here]
            here += ((bits[walk, here] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64)
        else:
            live = here - at < size
            now = np.where(live, here, 0)
            out[step] = np.where(live, words[now], np.uint64(0))
            here += ((bits[walk, now] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64) * live
    return out


@lru_cache(maxsize=256)
def draws(size: int, walks: int, tables: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and their multipliers, as draws x walks x tables, and what a key starts from, as walks x tables."""
    n = min(DRAWS, steps)
    places, factors = np.empty((n, walks, tables), np.int64), np.empty((n, walks, tables), np.uint64)
    for walk in range(walks):
        draw = np.random.RandomState(walk * 1009 + size)
        for table in range(tables):
            places[:, walk, table] = draw.choice(steps, n, replace=False)
            factors[:, walk, table] = (draw.randint(1, 1 << 62, n).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    first = (np.arange(walks * tables, dtype=np.uint64).reshape(walks, tables) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return places, factors, first


def sampled_keys(embedding: np.ndarray, size: int) -> np.ndarray:
    """A key for each walk's sampling sets and window: (walks x tables) x windows.

    Words are 64-bit hashes; a multiplier for each of the positions tells their order.
    """
    places, factors, first = draws(size, WALKS, TABLES, len(embedding))
    walk = np.arange(WALKS)[:, None]
    keys = np.repeat(first[:, :, None], embedding.shape[2], axis=2)
    for k in range(len(places)):
        keys += embedding[places[k], walk] * factors[k][:, :, None]
    return keys.reshape(WALKS * TABLES, -1)


def edit_distance(item: list[int], stretch: list[int]) -> int:
    """The smallest edit distance of the item to any part of stretch (bit-parallel over the item's words)."""
    n = len(item)
    where: dict[int, int] = {}
    for k, word in enumerate(item):
        where[word] = where.get(word, 0) | (1 << k)
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, n
    for word in stretch:
        eq = where.get(word, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = (minus | ~(zero | plus)) & full, plus & zero
        score += 1 if up & top else -1 if down & top else 0
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(zero | up)) & full, up & zero
        best = min(best, score)
    return best


def laid_out(texts: list[np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of many texts in one array, with `gap` zeros after each, and where each begins."""
    lengths = np.array([len(t) + gap for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()), np.uint64)
    for start, words in zip(starts.tolist(), texts, strict=True):
        flat[start : start + len(words)] = words
    return flat, starts


class Index:
    """A block of items, ready to look windows up in."""

    def __init__(self, items: list[tuple[int, str | None]], max_edit: float = MAX_EDIT):
        self.max_edit = max_edit
        hashed = batch_word_hashes([normalised(t) for _, t in items])
        kept = [(i, h) for (i, _), h in zip(items, hashed, strict=True) if len(h)]
        self.ids = [i for i, _ in kept]
        self.words = [h.tolist() for _, h in kept]
        lengths = np.array([len(h) for _, h in kept], np.int64)
        #: Zeros behind each text, so that no window reaches into the next one.
        self.gap = LONGEST + 1
        #: No item starts farther before a text than this.
        self.lead = int(lengths.max()) if len(kept) else 0
        flat, starts = laid_out([h for _, h in kept], 1)
        #: For each cell of word pairs, a bit for each of GRID in whose items it occurs.
        self.known = np.zeros(1 << PAIR_BITS, np.uint16)
        #: By window size: smallest and largest item, the keys' first bits, keys (sorted), their entries, and each entry's
        #: item and how far in its window starts.
        self.sizes: dict[int, tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        grid = np.array(GRID)
        size_of = np.where(lengths < MIN_WORDS, 0, grid[np.searchsorted(grid, lengths, "right") - 1])
        self.short = self._short(lengths)
        cache: dict = {}
        for size in np.unique(size_of[size_of > 0]).tolist():
            group = np.flatnonzero(size_of == size)
            for k in group.tolist():
                self.known[self.pair_cells(kept[k][1])] |= np.uint16(1 << GRID.index(size))
            places = [(k, at) for k in group.tolist() for at in sorted({*range(0, int(lengths[k]) - size, size), int(lengths[k]) - size})]
            item, shift = np.array(places, np.int32).T
            at = starts[item] + shift
            keys = np.concatenate([sampled_keys(embed(flat, at[low : low + AT_ONCE], size, cache), size) for low in range(0, len(at), AT_ONCE)], axis=1)
            entry = np.tile(np.arange(len(item), dtype=np.int32), len(keys))
            keys = keys.ravel()
            order = np.argsort(keys, kind="stable")
            first_bits = np.zeros(1 << KEY_BITS, bool)
            first_bits[keys >> np.uint64(64 - KEY_BITS)] = True
            self.sizes[size] = (int(lengths[group].min()), int(lengths[group].max()), first_bits, keys[order], entry[order], item, shift)

    def _short(self, lengths: np.ndarray) -> dict[bool, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For single words and for pairs: keys (sorted), their items, and how far in these they stand."""
        out = {}
        for paired in (False, True):
            rows = []
            for k in np.flatnonzero((lengths < MIN_WORDS) & ((lengths > 1) == paired)).tolist():
                keys = self.short_keys(np.array(self.words[k], np.uint64), paired).tolist()
                rows += [(keys[at], k, at) for at in sorted({0, len(keys) - 1})]
            rows.sort()
            keys, items, shifts = zip(*rows, strict=True) if rows else ((), (), ())
            out[paired] = (np.array(keys, np.uint64), np.array(items, np.int32), np.array(shifts, np.int32))
        return out

    @staticmethod
    def short_keys(words: np.ndarray, paired: bool) -> np.ndarray:
        return mixed(words[:-1] + words[1:] * np.uint64(3)) if paired else words

    @staticmethod
    def pair_cells(words: np.ndarray) -> np.ndarray:
        return (mixed(words[:-1] + words[1:] * np.uint64(3)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def windows(self, flat: np.ndarray, sums: np.ndarray, size: int, least: int, most: int) -> np.ndarray:
        """Starts of the windows that can be words of an item, by the known pairs around them: for items of up to two windows
        first or last words, for others any."""
        n = len(flat)
        need = min(m - 1 - 2 * allowed_edits(m, self.max_edit) for m in range(least, most + 1))
        span = most + allowed_edits(most, self.max_edit)
        wide = np.concatenate([np.zeros(span, np.int32), sums[:n], np.full(span + size, sums[-1], np.int32)])
        here = wide[span : span + n]
        after = wide[2 * span : 2 * span + n] - here
        before = wide[span + size : span + size + n] - wide[size : size + n]
        if most > 2 * size:
            around = wide[2 * span : 2 * span + n] - wide[size : size + n]
            return np.flatnonzero((around >= need) & (flat != 0))
        return np.flatnonzero(((after >= need) | (before >= need)) & (flat != 0))

    def hits(self, texts: list[np.ndarray]) -> list[dict[int, int]]:
        """For each text's words: item -> edit distance, for the items that it leaks."""
        found: list[dict[int, int]] = [{} for _ in texts]
        low = 0
        while low < len(texts) and self.ids:
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) + self.gap <= BATCH_WORDS):
                size += len(texts[high]) + self.gap
                high += 1
            self._search(texts[low:high], found[low:high])
            low = high
        return found

    def _search(self, texts: list[np.ndarray], found: list[dict[int, int]]) -> None:
        flat, begin = laid_out(texts, self.gap)
        known = self.known[self.pair_cells(flat)] * ((flat[:-1] != 0) & (flat[1:] != 0))
        listed: dict[int, list[int]] = {}
        tried: set[tuple[int, int, int]] = set()
        cache: dict = {}
        for paired, (keys, items, shifts) in self.short.items():
            if not len(keys):
                continue
            row = self.short_keys(flat, paired)
            first, last = np.searchsorted(keys, row, "left"), np.searchsorted(keys, row, "right")
            for j in np.flatnonzero((last > first) & (flat[: len(row)] != 0)).tolist():
                doc = int(np.searchsorted(begin, j, "right")) - 1
                for k in range(int(first[j]), int(last[j])):
                    self._verify(int(items[k]), j - int(shifts[k]), doc, texts, begin, listed, found)
        for size, (least, most, first_bits, keys, entries, items, shifts) in self.sizes.items():
            sums = np.concatenate([[0], np.cumsum((known >> np.uint16(GRID.index(size))) & np.uint16(1), dtype=np.int32)])
            at = self.windows(flat, sums, size, least, most)
            for low in range(0, len(at), AT_ONCE):
                some = at[low : low + AT_ONCE]
                row = sampled_keys(embed(flat, some, size, cache), size).ravel()
                maybe = np.flatnonzero(first_bits[row >> np.uint64(64 - KEY_BITS)])
                first = np.searchsorted(keys, row[maybe], "left")
                counts = np.searchsorted(keys, row[maybe], "right") - first
                entry = entries[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
                place = np.repeat(some[maybe % len(some)], counts)
                # Each item and start once, as one number; the text is that of a window which led there.
                codes, led = np.unique((items[entry].astype(np.int64) << 32) + (place - shifts[entry] + self.lead), return_index=True)
                docs = np.searchsorted(begin, place[led], "right") - 1
                for code, doc in zip(codes.tolist(), docs.tolist(), strict=True):
                    item, start = code >> 32, (code & 0xFFFFFFFF) - self.lead
                    if (item, doc, start // 4) not in tried:
                        tried.add((item, doc, start // 4))
                        self._verify(item, start, doc, texts, begin, listed, found)

    def _verify(self, item: int, start: int, doc: int, texts: list, begin: np.ndarray, listed: dict, found: list) -> None:
        """Enters the item's edit distance to the stretch of doc near the word `start`, if it is a leak and the best so far."""
        length = len(self.words[item])
        best = found[doc].get(item, allowed_edits(length, self.max_edit) + 1)
        if best == 0:
            return
        if doc not in listed:
            listed[doc] = texts[doc].tolist()
        room = allowed_edits(length, self.max_edit) + 4
        start -= int(begin[doc])
        d = edit_distance(self.words[item], listed[doc][max(0, start - room) : max(0, start + length + room)])
        if d < best:
            found[doc][item] = d


def item_blocks(benchmark: DataFrame, block: int = ITEM_BLOCK):
    """Indexes of the benchmark's items, about `block` stretches at a time; the driver holds one block."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    blocks = -(-int(items.agg(F.sum(F.ceil((word_count(F.col("text")) + 1) / LONGEST))).first()[0] or 0) // block)
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield Index([(r.item_id, r.text) for r in part.collect()])


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = ITEM_BLOCK) -> DataFrame:
    """doc_id, item_id, distance, item_words: a row for each document and item that it leaks."""

    def searcher(index: Index):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for batch in batches:
                rows = []
                hits = ix.hits(batch_word_hashes([normalised(t) for t in batch.column("text").to_pylist()]))
                for doc_id, found in zip(batch.column("doc_id").to_pylist(), hits, strict=True):
                    rows += [(doc_id, ix.ids[k], d, len(ix.words[k])) for k, d in found.items()]
                columns = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "item_words"])

        return search

    schema = "doc_id long, item_id long, distance long, item_words long"
    parts = [docs.select("doc_id", "text").mapInArrow(searcher(ix), schema) for ix in item_blocks(benchmark, block)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, block: int = ITEM_BLOCK) -> DataFrame:
    """The rows of docs that leak no item; texts stay where they are."""
    spark = docs.sparkSession
    for ix in item_blocks(benchmark, block):
        shared = spark.sparkContext.broadcast(ix)

        @F.pandas_udf("boolean")
        def leaky(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = shared.value  # noqa: B023  (bound before the next block is built)
            for texts in batches:
                yield pd.Series([bool(h) for h in index.hits(batch_word_hashes([normalised(t) for t in texts]))], index=texts.index, dtype=bool)

        docs = docs.where(~leaky("text"))
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", 1 - F.col("distance") / F.col("item_words"))
