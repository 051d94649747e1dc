"""Exact, near, line and suffix dedup against brute force on small tables with odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from wirelens.llm import exact_dedup, line_dedup, near_dedup, suffix_dedup, suffixes
from wirelens.llm.common import Work
from wirelens.llm.components import components

SCHEMA = "doc_id long, text string, source string, key long, hash long, no int, block long, rep long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.randint(30, 120)) for _ in range(25)]
    out = []
    for text in base:
        out.append(text)
        w = text.split()
        for _ in range(3):  # near copies
            copy = list(w)
            for _ in range(rng.choice((1, 2, 6))):
                copy[rng.randrange(len(copy))] = "zz" + str(rng.randrange(99))
            out.append(" ".join(copy))
        out.append("  " + text.replace(" ", "\n", 2) + "\t")  # equal but for white space
    passage = "\n".join(words(rng, 12) for _ in range(6))
    out += [f"{words(rng, 8)}.\n{passage}\n{words(rng, 9)}." for _ in range(12)]
    out += ["", "", " \n ", "one", "ONE", "one two three", "É " * 40, "x" * 5000, ". " * 300, "\n".join("ab" * 3 for _ in range(50)), words(rng, 4000)]
    rng.shuffle(out)
    made = [(k, t) for k, t in enumerate(out)]
    made += [(None, out[0]), (None, "only unnamed text here " * 5), (500, None), (None, None), made[3], made[3]]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3, 4, 5) for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture
def work(spark):
    return Work(spark)


def last(i):
    return 1 << 62 if i is None else i


def test_exact(docs, rows, work):
    got = exact_dedup.exact_duplicates(docs, work).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, last(i)))
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        g = by_sha[r.text_sha256]
        best = min(g)
        assert (r.group_size, last(r.keep_id)) == (len(g), best[2])
    assert sum(r.kept for r in got) == len(groups)


def test_exact_splits_chunks_that_share_an_id(spark):
    chunks = spark.createDataFrame([(1, bytearray(b"a")), (1, bytearray(b"b")), (1, bytearray(b"b")), (2, bytearray(b"a"))], "id long, sha binary")
    assert sorted((r.id, r.variant) for r in exact_dedup.verified_identifiers(chunks).collect()) == [(1, 1), (1, 2), (2, 1)]


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_brute(rows):
    """(doc_id, n_shingles, component_id, kept) of each row; rows are linked by their sets, and by a doc_id that they share."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            same = rows[a][0] is not None and rows[a][0] == rows[b][0]
            if x and y and (same or 100 * len(x & y) >= 75 * len(x | y)):
                parent[root(a)] = root(b)
    named = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            named[root(k)] = min(i, named.get(root(k), i))
    return [(i, len(sets[k]), named.get(root(k)), i == named.get(root(k))) for k, (i, _) in enumerate(rows)]


def near_rows(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_near(docs, rows, work):
    assert near_rows(near_dedup.near_duplicates(docs, work)) == sorted(near_brute(rows), key=repr)


def test_near_with_large_and_shared_ids(spark, work):
    """Any long is a doc_id, and rows that share one are linked through it."""
    rng = random.Random(13)
    t, u, v = (words(rng, 40) for _ in range(3))
    top = (1 << 63) - 1
    made = [(1 << 62, t), ((1 << 62) + 5, u), (3, t), (7, t), (7, u), (9, u), (top, v), (-(1 << 63), v), (7, ""), (None, u), (None, "x y")]
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    got = near_rows(near_dedup.near_duplicates(frame, work))
    assert got == sorted(near_brute(made), key=repr)
    assert {r[2] for r in got if r[0] in (3, 7, 9) and r[1]} == {3}


def test_components_of_links(spark, work):
    rng = random.Random(14)
    links = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(300, 380)] + [(500 + rng.randrange(80), 500 + rng.randrange(80)) for _ in range(60)]
    links += [(9000 - k, 1000 + rng.randrange(6)) for k in range(50)] + [(1, 1), (2, 0), (-5, 1 << 62)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long").repartition(3), work).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(root(x), set()).add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)
    assert components(spark.createDataFrame([], "a long, b long"), work).count() == 0


def test_one_row_of_a_group_of_copies_stays(spark, work):
    rng = random.Random(12)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    near = " ".join(["other", *a.split()[1:]])
    made = [(5, a), (5, a), (5, a), (9, near), (None, a), (None, b), (None, b), (None, b), (7, c), (7, near), (8, d), (8, d), (3, ""), (3, ""), (4, ""), (None, "")]
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(made)], "doc_id long, text string, key int").repartition(3)
    got = near_dedup.without_copies(frame, work)
    assert got.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(5, a), (None, b), (7, c), (8, d), (3, ""), (4, ""), (None, "")], key=repr)
    again = spark.createDataFrame([(3, a), (7, a), (7, b), (9, b)], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.without_copies(again, work).collect())) == [(3, a), (7, b)]


@pytest.mark.parametrize("tile", [7, 1000])
def test_near_tiles_join_all_that_is_linked(spark, tile):
    """Whatever the tile size, the links of all tiles connect what the links of all pairs connect, and are links."""
    rng = random.Random(8)
    text = words(rng, 150).split()
    made = []
    for k in range(60):
        copy = list(text)
        for _ in range(rng.randint(2, 5)):
            copy[rng.randrange(150)] = f"q{k}x{rng.randrange(9)}"
        made.append((k, " ".join(copy)))
    docs = spark.createDataFrame(made, "rep long, text string")
    want = {(a, b) for b in range(60) for a in range(b) if 100 * len((x := shingle_set(made[a][1])) & (y := shingle_set(made[b][1]))) >= 75 * len(x | y)}
    signed = docs.mapInArrow(near_dedup._signatures, f"rep long, {near_dedup.SIGNED}").cache()
    sigs = signed.select("rep", "sig")
    sets = docs.mapInPandas(near_dedup._sets, "digest binary, items array<long>").join(signed, "digest").select("rep", "items").cache()
    band = F.expr("transform(sequence(0, 31), b -> xxhash64(b, slice(sig, b * 4 + 1, 4)))")
    rows = sigs.select("rep", F.posexplode_outer(band).alias("band", "bucket")).withColumn("comp", F.col("rep")).withColumn("size", F.lit(60).cast("long")).withColumn("shingles", F.lit(9000).cast("long"))
    got = {(r.a, r.b) for r in near_dedup.unconnected_links(rows, sigs, sets, tile).collect()}

    def groups(links):
        parent = list(range(60))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return [root(k) for k in range(60)]

    assert got <= want
    assert groups(got) == groups(want)


def test_bayes_bounds():
    least = near_dedup.least_matches()
    assert least == sorted(least)
    assert 0 <= least[0] < 12
    assert least[-1] < 96


def lines_brute(rows):
    """doc -> kept text, by the rules stated in the operator."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    seen, out = {}, {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, last(r[0]), r[1] or "")):
        if t is None:
            out[i, t] = (None, 0, 0)
            continue
        lines = t.split("\n")
        h = [md5(x) for x in lines]
        chunks, held = [], []
        for k, x in enumerate(lines):
            held.append(x)
            if k == len(lines) - 1 or md5((h[k - 1] if k else "") + h[k])[0] < line_dedup.BOUNDARY_BELOW:
                chunks.append(held)
                held = []
        kept, gone = [], 0
        for c in chunks:
            solid = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in c) >= 2
            if solid and "\n".join(c) in seen:
                gone += len(c)
            else:
                kept += c
            if solid:
                seen.setdefault("\n".join(c), i)
        out[i, t] = ("\n".join(kept), len(lines), gone)
    return out


def test_lines(docs, rows, work):
    named = [(i, t) for i, t in rows if i is not None]  # the order of unnamed documents is by hash
    got = line_dedup.dedup_lines(docs.where("doc_id IS NOT NULL"), work).collect()
    want = lines_brute(named)
    texts = dict(named)
    assert sorted(((r.doc_id, r.text, r["__n_lines"], r["__n_removed"]) for r in got), key=repr) == sorted(((i, *want[i, texts[i]]) for i, _ in named), key=repr)
    assert sum(r["__n_removed"] for r in got) > 10
    assert {"source", "key", "hash", "no"} <= set(got[0].asDict())
    assert line_dedup.dedup_lines(docs, work).count() == len(rows)


def passages_brute(rows):
    """doc -> (text left, lines gone), from all pairs of neighbouring lines that aren't blank; knows no chunk boundaries."""
    first, out = {}, {}
    for i, t in sorted(set(rows), key=lambda r: (r[0], r[1] or "")):
        lines = (t or "").split("\n")
        solid = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for a, b in zip(solid, solid[1:], strict=False):
            doc, end = first.setdefault(tuple(lines[a : b + 1]), (i, b))
            if doc != i or a > end:
                gone |= set(range(a, b + 1))
        out[i] = (None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def test_repeated_passages_leave_no_line(spark, docs, rows, work):
    rng = random.Random(9)
    planted = [[words(rng, 12) for _ in range(rng.choice((2, 2, 2, 3, 4, 6)))] for _ in range(60)]
    planted[0].insert(1, "")
    made = []
    for k in range(180):  # each passage thrice, between lines of its own
        made.append((k, "\n".join([words(rng, 9), *planted[k % 60], words(rng, 9)])))
    made += [(900, "a a\na a\na a"), (901, "b b\n" * 4), (902, "c\nd\nc\nd\nc"), (903, "c\n\nd"), (904, ""), (905, None), made[70]]
    frame = spark.createDataFrame([(i, t, 1) for i, t in made], "doc_id long, text string, first int").repartition(5)
    want = passages_brute(made)
    got = line_dedup.dedup_passages(frame, work).collect()
    assert len(got) == len(made)
    assert {r.doc_id: (r.text, r["__n_removed"]) for r in got} == want
    for r in got:
        if 60 <= r.doc_id < 180:
            assert r["__n_lines"] - r["__n_removed"] == 2  # its own lines
    named = [(i, t) for i, t in rows if i is not None]
    again = line_dedup.dedup_passages(docs.where("doc_id IS NOT NULL"), work).collect()
    assert {r.doc_id: (r.text, r["__n_removed"]) for r in again} == passages_brute(named)
    assert line_dedup.dedup_passages(docs, work).count() == len(rows)
    chunks = line_dedup.dedup_lines(frame, work).collect()
    assert sum(r["__n_removed"] for r in got) > sum(r["__n_removed"] for r in chunks)


def test_passages_go_by_chunks_of_the_rolling_hash(spark, docs, rows, work, monkeypatch):
    """The pipeline's stage removes op9's chunks by their own places; line pairs are looked for in the other lines only."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    named = docs.where("doc_id IS NOT NULL")
    spans = {(r.doc_id, k) for r in line_dedup.lost_spans(named, work).collect() for k in range(r.low, r.high + 1)}
    texts = {i: t for i, t in rows if i is not None}
    want = set()
    for r in line_dedup.lost_chunks(named, work).collect():  # op9's
        chunks, low = line_dedup.with_chunks(spark.createDataFrame([(texts[r.doc_id],)], "text string")).first()["__chunks"], 0
        for k, c in enumerate(chunks):
            solid = [low + j for j, x in enumerate(c) if x.strip(" \t\n\x0b\x0c\r")]
            want |= {(r.doc_id, j) for j in range(solid[0], solid[-1] + 1)} if k in r.gone else set()
            low += len(c)
    assert spans == want and len(want) > 10
    asked, places = [], line_dedup.lost_places

    def spy(d, w, rows_of, known=None):
        asked.append((rows_of, known and {(r.doc_id, r.no) for r in known.collect()}))
        return places(d, w, rows_of, known)

    monkeypatch.setattr(line_dedup, "lost_places", spy)
    assert corpus_pipeline.drop_repeated_lines(spark, named, "").count() == named.count()
    assert [f for f, _ in asked] == [line_dedup.chunk_places, line_dedup.pair_rows]
    assert asked[1][1] and asked[1][1] < spans


def suffix_brute(rows):
    first = {}
    data = [(last(i), (t or "").encode()) for i, t in rows]
    for i, b in sorted(data):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = []
    for (i, _), (rank, b) in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < rank:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("block_bytes", [4 << 20, 3000])
def test_suffixes(docs, rows, work, monkeypatch, block_bytes):
    pack = suffix_dedup.pack
    monkeypatch.setattr(suffix_dedup, "pack", lambda d, w, hole: pack(d, w, hole, block_bytes))
    got = suffix_dedup.dedup_suffixes(docs, work).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(suffix_brute(rows), key=repr)


@pytest.mark.parametrize("extra", [[], [-(1 << 63)]])
def test_suffixes_of_any_doc_id(spark, work, extra):
    rng = random.Random(15)
    shared, other = words(rng, 30), words(rng, 30)
    top = (1 << 63) - 1
    made = [(top, shared + " a"), (None, "b " + shared), (None, shared), (top - 1, "c " + other), (top, other), (0, "x"), (-1, other + " d"), (1 << 62, shared + " e")]
    made += [(i, shared + " f") for i in extra]
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(2)
    order = sorted({i for i, _ in made if i is not None})
    ranked = [(len(order) if i is None else order.index(i), t) for i, t in made]  # brute force over places in the order
    want = [((*order, None)[r[0]], *r[1:]) for r in suffix_brute(ranked)]
    got = suffix_dedup.dedup_suffixes(frame, work).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_suffixes_of_a_very_long_text(spark, work):
    rng = random.Random(16)
    passage = words(rng, 40)
    long = words(rng, 150_000)
    made = [(1, "start " + passage), (2, long[:300_000] + " " + passage + " " + long[300_000:])]
    got = {r.doc_id: r for r in suffix_dedup.dedup_suffixes(spark.createDataFrame(made, "doc_id long, text string"), work).collect()}
    assert got[1].n_removed == 0
    assert got[2].n_bytes == len(made[1][1])
    assert (got[2].n_spans, bytes(got[2].kept)) == (1, (long[:300_000] + long[300_000:]).encode()) or len(passage) <= got[2].n_removed <= len(passage) + 2


def test_shards_are_sorted_in_piles(monkeypatch):
    """However many bytes a shard gets, a suffix array is of a bounded number, and strings in contexts of several sizes meet."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(17)
    texts = [words(rng, 200).encode() for _ in range(40)]
    made = [(t, i) for i, t in enumerate(texts)] + [(b"y" + texts[k % 40] + b"z", 100 + k) for k in range(400)]
    blocks = []
    for t, i in made:
        n = np.array([len(t)])
        blocks.append(suffix_dedup.Block({"ids": np.array([i]).tobytes(), "lengths": n.tobytes(), "data": t}))
    rows = []
    for k, (b, (t, i)) in enumerate(zip(blocks, made, strict=True)):
        a = b.anchors
        assert a.count.sum() == len(t) - 49  # every window has one anchor
        for _, pile, start, size, least, _, _ in b.contexts(1, np.arange(len(a.start)), a.start, a.count):
            rows.append((0, k, size.astype("<u2").tobytes(), pile.tobytes(), least.tobytes(), b.data[suffix_dedup.ranges(start, size)].tobytes()))
    table = pa.table(dict(zip(("shard", "block", "sizes", "piles", "least", "data"), map(list, zip(*rows, strict=True)), strict=True)))
    sorted_at_once, sort = [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda d, depth: sorted_at_once.append(len(d)) or sort(d, depth))
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 50_000)
    got = suffix_dedup._sources(table)
    assert sum(map(len, table["data"].to_pylist())) > 1_000_000
    assert max(sorted_at_once) < 60_000
    first = {}
    for t, i in made:
        for w in range(len(t) - 49):
            first.setdefault(t[w : w + 50], i)
    for row, (_, _, sizes, _, _, data) in zip(got.to_pylist(), rows, strict=True):
        found = np.repeat(np.frombuffer(row["sources"], np.int64), np.frombuffer(row["counts"], "<u4")).tolist()
        low = 0
        for n in np.frombuffer(sizes, "<u2").tolist():
            strings = [data[low + w : low + w + 50] for w in range(n - 49)]
            assert found[: n - 49] == [first[x] for x in strings]
            found, low = found[n - 49 :], low + n


def test_blocks_are_read_a_few_at_a_time(spark, work):
    """A reader holds a whole row group, so a partition's blocks aren't one."""
    import glob

    import pyarrow.parquet as pq

    docs = spark.range(32, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat(sha2(string(id), 512), 8192)").alias("text"))
    blocks = suffix_dedup.pack(docs, work)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(blocks._work_path.removeprefix("file:") + "/*.parquet")]
    assert sum(f.num_rows for f in files) == 8
    assert max(f.row_group(k).total_byte_size for f in files for k in range(f.num_row_groups)) < 4 * suffix_dedup.BLOCK_BYTES
    assert max(f.row_group(k).num_rows for f in files for k in range(f.num_row_groups)) <= 3


def test_suffix_array_is_sorted():
    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        n, size = rng.choice((1, 2, 3, 9, 60, 200, 1500)), rng.choice((1, 2, 3, 20))
        d = bytes(97 + rng.randrange(size) for _ in range(n))
        a = np.frombuffer(d, np.uint8)
        order = suffixes.suffix_array(a, n + 1)
        assert order.tolist() == sorted(range(n), key=lambda k: d[k:])
        near = suffixes.suffix_array(a, 5)
        assert [d[k : k + 5] for k in near] == [d[k : k + 5] for k in order]
        common = suffixes.common_prefixes(a, order, 50)
        for x, y in zip(order[1:], order, strict=False):
            m = 0
            while m < min(50, n - max(x, y)) and d[x + m] == d[y + m]:
                m += 1
            assert common[x] == m


@pytest.mark.parametrize("run", [lambda d, w: exact_dedup.exact_duplicates(d, w), lambda d, w: near_dedup.near_duplicates(d, w), lambda d, w: line_dedup.dedup_lines(d, w), lambda d, w: suffix_dedup.dedup_suffixes(d, w)])
def test_empty_table(spark, work, run):
    assert run(spark.createDataFrame([], "doc_id long, text string"), work).count() == 0
