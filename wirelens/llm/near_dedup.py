"""MinHash near-dedup with sequential Bayesian verification.

Documents are linked when the sets of their 5-word shingles have a Jaccard similarity of 0.75 or more. One pass makes a
signature of 128 minimum hashes per row; rows with equal sets, told by a SHA-256 of the whole sorted set, are one
class, and classes have numbers of their own: a doc_id names no class. 32 bands of 4 rows give candidates: two
documents at the threshold share a band but for 5 in a million. A candidate pair's signatures are compared 16 hashes
at a time, and the pair is dropped as soon as the posterior probability that it reaches the threshold (uniform prior) is
below MISS; what survives is verified on the full shingle sets.

A bucket of many members isn't expanded into all its pairs. First every member is compared with the bucket's
centre, the member that shares the largest buckets, then with a random member; a group of copies becomes one
component that way. Links between components are all that a round hands on, and their spanning forest all that
stays of them. At last the members of a bucket that still aren't connected are compared and verified in tiles, in
memory, so that no link between components is lost, and only links that join two components become rows.

Edge cases: a text with fewer words than a shingle is one shingle; one without words, empty or null, has no
shingles, is linked with nothing and is a component of its own. Rows that share a doc_id are one document to
near_duplicates: what one of them is linked with, all are. A null doc_id is an unnamed document: it may join a component,
and its component_id is null where no named document is reachable; kept is then true. without_copies, which
the pipeline uses, judges every row by its text alone: repeated rows and unnamed ones with one text are copies of each
other, and different texts under one doc_id are judged apart. Extra columns are ignored or carried along; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, read_table
from .components import components, relabelled
from .shingles import batch_word_hashes, shingles_of

SHINGLE = 5
HASHES = 128
ROWS = 4
STEP = 16
PERCENT = 75
#: The chance, at most, that one comparison step drops a pair which reaches the threshold.
MISS = 1e-6
#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Rounds in which a bucket's members are compared with one of them.
STARS = 3
#: Members of a bucket that are compared with each other within one task, and the shingles that they may have on average.
TILE = 1024
TILE_SHINGLES = 2_000_000
SIGNED = "n long, digest binary, sig array<int>"


def _signer():
    draw = np.random.RandomState(7)
    factors = (draw.randint(1, 1 << 62, HASHES).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    offsets = draw.randint(1, 1 << 62, HASHES).astype(np.uint64)

    def sign(unique: np.ndarray) -> np.ndarray:
        least = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
        for low in range(0, len(unique), 512):
            part = np.multiply.outer(unique[low : low + 512], factors)
            part += offsets
            np.minimum(least, part.min(axis=0), out=least)
        return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)

    return sign


def _digest(unique: np.ndarray) -> bytes:
    return hashlib.sha256(unique.tobytes()).digest()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns but text, with n, digest and sig; a text without shingles has neither digest nor sig."""
    sign = _signer()
    for batch in batches:
        out = []
        for words in batch_word_hashes(batch.column("text").to_pylist()):
            unique = np.unique(shingles_of(words, SHINGLE))
            out.append((len(unique), _digest(unique), sign(unique)) if len(unique) else (0, None, None))
        n, digests, sigs = zip(*out, strict=True) if out else ((), (), ())
        kept = [name for name in batch.schema.names if name != "text"]
        made = [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *made], [*kept, "n", "digest", "sig"])


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [np.unique(shingles_of(w, SHINGLE)) for w in batch_word_hashes(pdf["text"].tolist())]
        yield pd.DataFrame({"digest": [_digest(x) for x in sets], "items": pd.Series([x.view(np.int64) for x in sets], dtype=object)})


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For 16, 32, ... hashes compared: the fewest matches with which a pair goes on.

    With a uniform prior, the similarity after m matches of n is Beta(m + 1, n - m + 1); that it reaches t has the
    probability that n + 1 draws with chance t give m successes at most.
    """
    t, found = percent / 100, []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        found.append(m)
    return found


def _survivors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    least = least_matches()
    for pdf in batches:
        if not len(pdf):
            continue
        left, right = np.stack(pdf["sig_a"].to_numpy()), np.stack(pdf["sig_b"].to_numpy())
        alive, matches = np.arange(len(pdf)), np.zeros(len(pdf), int)
        for k, need in enumerate(least):
            part = slice(k * STEP, (k + 1) * STEP)
            matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1)
            alive, matches = alive[matches >= need], matches[matches >= need]
        yield pdf[["a", "b", "ca", "cb"]].iloc[alive]


def few_enough(ids: DataFrame) -> DataFrame:
    """ids, marked for a broadcast below a checked count; beyond it a join with them shuffles."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def verified(pairs: DataFrame, sets: DataFrame, work: Work) -> DataFrame:
    """The links (a, b) between components that pairs (a, b, ca, cb) make whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("items").alias("items_a")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("items").alias("items_b")), "b"
    )
    shared = both.withColumn("i", F.size(F.array_intersect("items_a", "items_b")).cast("long")).withColumn(
        "u", F.size("items_a") + F.size("items_b") - F.col("i")
    )
    reach = shared.where(F.col("i") * 100 >= F.col("u") * PERCENT)
    return work.save(reach.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")


def compared(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b, ca, cb) that the sequential comparison of their signatures lets through."""
    signed = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(
        sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b"
    )
    return signed.select("a", "b", "ca", "cb", "sig_a", "sig_b").mapInPandas(_survivors, "a long, b long, ca long, cb long")


def _tile_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (bucket, i, j, t, band, rep, comp, sig, items), sorted by tile: links between its components that join them.

    Pairs of different components are compared by signature; those let through are verified on the full sets, the most
    alike first, until their components are joined. A pair that shares several bands is looked at in the first of them
    only. A tile of m members gives m - 1 links at most.
    """
    least = least_matches()
    held: list[pd.DataFrame] = []
    key = None

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        t, i, j, band = rows["t"].to_numpy(), rows["i"].iloc[0], rows["j"].iloc[0], int(rows["band"].iloc[0])
        rep, comp, sig, items = rows["rep"].to_numpy(), rows["comp"].to_numpy(), np.stack(rows["sig"].to_numpy()), rows["items"].tolist()
        left, right = np.flatnonzero(t == i), np.flatnonzero(t == j)
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = c = parent.get(up, up)
            return c

        out = []
        for low in range(0, len(left), 64):
            some = left[low : low + 64]
            ok = comp[some][:, None] != comp[right][None, :]
            if i == j:
                ok &= rep[some][:, None] < rep[right][None, :]
            x, y = np.nonzero(ok)
            x, y = some[x], right[y]
            matches = np.zeros(len(x), int)
            for k, need in enumerate(least):
                if not len(x):
                    break
                part = slice(k * STEP, (k + 1) * STEP)
                same = sig[x, part] == sig[y, part]
                matches = matches + same.sum(axis=1)
                stay = matches >= need
                for g in range(STEP // ROWS):  # a band before this one that they share
                    if k * (STEP // ROWS) + g < band:
                        stay &= ~same[:, g * ROWS : (g + 1) * ROWS].all(axis=1)
                x, y, matches = x[stay], y[stay], matches[stay]
            for k in np.argsort(-matches, kind="stable").tolist():
                u, v = int(x[k]), int(y[k])
                cu, cv = root(int(comp[u])), root(int(comp[v]))
                if cu != cv and linked(items[u], items[v]):
                    parent[max(cu, cv)] = min(cu, cv)
                    out.append((min(comp[u], comp[v]), max(comp[u], comp[v])))
        return pd.DataFrame(out, columns=["a", "b"])

    for pdf in batches:
        keys = list(zip(pdf["bucket"], pdf["i"], pdf["j"], strict=True))
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            if keys[low] != key and held:
                yield tile(pd.concat(held) if len(held) > 1 else held[0])
                held = []
            key = keys[low]
            held.append(pdf.iloc[low:high])
    if held:
        yield tile(pd.concat(held) if len(held) > 1 else held[0])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted arrays) reach the threshold."""
    few, many = (a, b) if len(a) < len(b) else (b, a)
    if 100 * len(few) < PERCENT * len(many):
        return False
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    shared = int((many[at] == few).sum())
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def unconnected_links(rows: DataFrame, sigs: DataFrame, sets: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) between components of rows(bucket, band, rep, comp, size, shingles) which share a bucket.

    A bucket is cut into tiles of `tile` members (fewer, if their sets are large); every two tiles meet in one task, where
    their pairs are looked at in memory. Signatures and sets go along, and only links that join two components become rows.
    """
    cells = F.ceil(F.greatest(F.col("size") / tile, F.col("shingles") / TILE_SHINGLES))
    placed = rows.withColumn("t", F.pmod(F.xxhash64("rep"), cells)).withColumn("o", F.explode(F.sequence(F.lit(0), cells.cast("int") - 1)))
    tiles = placed.select("bucket", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "band", "rep", "comp")
    return (
        tiles.join(sigs, "rep")
        .join(sets.select("rep", F.sort_array("items").alias("items")), "rep")
        .select("bucket", "i", "j", "t", "band", "rep", "comp", "sig", "items")
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
        .mapInPandas(_tile_links, "a long, b long")
    )


def linked_classes(docs: DataFrame, classes: DataFrame, work: Work) -> list[DataFrame]:
    """Steps (node, comp) of classes into components, to be applied one after the other; docs (doc_id, th, text) has the texts.

    classes: rep, digest, n, sig and at, the doc_id and text hash of one of its rows.
    """
    bands = classes.select(
        "rep", "n", F.posexplode_outer(F.expr(f"transform(sequence(0, {HASHES // ROWS - 1}), b -> xxhash64(b, slice(sig, b * {ROWS} + 1, {ROWS})))")).alias("band", "bucket")
    )
    # Aggregates are written before they are joined: the join's exchanges can then be split where a key is hot.
    sizes = work.save(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).where("size > 1"), "sizes")
    places = work.save(bands.drop("n").join(sizes, "bucket"), "buckets")
    weights = work.save(places.groupBy("rep").agg(F.sum("size").alias("weight")), "weights")
    candidates = work.save(classes.join(weights, "rep").select("rep", "digest", "sig", "at.doc_id", "at.th"), "candidates")
    sigs = candidates.select("rep", "sig")
    where = few_enough(candidates.select(F.col("doc_id").alias("of"), F.col("th").alias("hash")).distinct())
    texts = docs.join(where, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("hash")), "left_semi").select("text")
    found = texts.mapInPandas(_sets, "digest binary, items array<long>").groupBy("digest").agg(F.first("items").alias("items"))
    sets = work.save(found.join(candidates.select("rep", "digest"), "digest").select("rep", "items"), "sets")
    steps = []
    open_places = places.withColumn("comp", F.col("rep"))
    for turn in range(STARS):
        # Who is the bucket's centre: first the member that shares the largest buckets, then any one.
        ranked = open_places.join(weights, "rep") if turn == 0 else open_places.withColumn("weight", F.xxhash64("bucket", "rep", F.lit(turn)))
        centres = work.save(ranked.groupBy("bucket").agg(F.max(F.struct("weight", "rep", "comp")).alias("m")), "centres")
        star = open_places.join(centres, "bucket").where(F.col("comp") != F.col("m.comp"))
        ends = lambda f: f(F.struct("rep", "comp"), F.struct("m.rep", "m.comp"))
        pairs = star.select(ends(F.least).alias("x"), ends(F.greatest).alias("y")).distinct().select(
            F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb")
        )
        step = components(verified(work.save(compared(pairs, sigs), "survivors"), sets, work), work)
        steps.append(step)
        labelled = relabelled(open_places.where("size > 2"), "comp", step)
        split = work.save(labelled.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket"), "split")
        open_places = work.save(labelled.join(split, "bucket"), "open")
        if not open_places.limit(1).count():
            return steps
    # What is left: members of one bucket that still aren't connected.
    return [*steps, components(work.save(unconnected_links(open_places, sigs, sets).distinct(), "links"), work)]


def with_classes(rows: DataFrame, docs: DataFrame, work: Work) -> DataFrame:
    """rep, digest, comp (a class's number, that of one of its component) and id (its smallest doc_id).

    rows (doc_id, th, n, digest, sig) are what _signatures makes of docs (doc_id, th, text).
    """
    grouped = rows.where("n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min(F.struct("doc_id", "th")).alias("at"), F.min("doc_id").alias("id"))
    classes = work.save(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes")
    named = classes.select("rep", "digest", "id", F.col("rep").alias("comp"))
    for step in linked_classes(docs, classes, work):
        named = relabelled(named, "comp", step)
    return work.save(named, "components")


def signed(docs: DataFrame, work: Work) -> DataFrame:
    """What _signatures makes of docs, written."""
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return work.save(docs.mapInArrow(_signatures, f"{kept}, {SIGNED}"), "signatures")


def near_duplicates(docs: DataFrame, work: Work) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = signed(texts, work)
    classes = with_classes(rows, texts, work)
    # Different texts under one doc_id: each of their components is linked with the least of them.
    spread = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high")
    shared = rows.where("n > 0").select("doc_id", "digest").join(work.save(spread.select("doc_id"), "shared"), "doc_id").distinct()
    owners = work.save(shared.join(classes.select("digest", "comp"), "digest").select("doc_id", "comp").distinct(), "owners")
    first = owners.groupBy("doc_id").agg(F.min("comp").alias("b"))
    classes = relabelled(classes, "comp", components(owners.join(first, "doc_id").select(F.col("comp").alias("a"), "b"), work))
    least = work.save(classes.groupBy("comp").agg(F.min("id").alias("component")), "least")
    labels = work.save(classes.join(least, "comp").select("digest", "component"), "labels")
    work.keep_only(rows, labels)
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return (
        rows.select("doc_id", "n", "digest")
        .join(labels, "digest", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    )


def without_copies(docs: DataFrame, work: Work) -> DataFrame:
    """One row of docs of each component: the one with the smallest doc_id, an unnamed one only where none is named.

    Rows without shingles have no copies but for repeated rows of one doc_id.
    """
    # Written, so that a row keeps its number.
    rows = work.save(docs.withColumn("__key", F.monotonically_increasing_id()), "rows")
    texts = rows.select("__key", "doc_id", F.xxhash64("text").alias("th"), "text")
    marks = signed(texts, work)
    labels = with_classes(marks, texts, work).select("digest", "comp")
    solid = marks.where("n > 0").select("__key", "doc_id", "digest").join(labels, "digest").select("comp", "doc_id", "__key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"), F.col("__key"))).alias("first")
    best = solid.groupBy("comp").agg(first)
    bare = marks.where("n = 0 AND doc_id IS NOT NULL").groupBy("doc_id", "th").agg(first)
    stay = work.save(best.select("first.__key").unionByName(bare.select("first.__key")), "stay")
    gone = work.save(marks.where("n > 0 OR doc_id IS NOT NULL").select("__key").join(stay, "__key", "left_anti"), "copies")
    work.keep_only(rows, gone)
    return rows.join(few_enough(gone), "__key", "left_anti").drop("__key")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), Work(spark))


ORACLE = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i : i + {SHINGLE - 1}], ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= {PERCENT} * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS comp FROM documents UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.node WHERE r.comp < e.b),
c AS (SELECT node, min(comp) AS comp FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.comp AS component_id, c.comp = d.doc_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
