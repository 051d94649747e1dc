"""HTML text, decontamination, chat formatting, token counts, quality, mixing and the pipeline."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from wirelens.llm import chat_format, decontaminate, html_text, quality, queries, source_mix, token_counts
from wirelens.llm.common import Work

SF = "/root/testdata/sf0.001"


@pytest.fixture
def work(spark):
    return Work(spark)


def words(rng, n):
    return [("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))) for _ in range(n)]


# --- HTML


def text_of(html, templates=frozenset()):
    return html_text.Page(html, templates).text()


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<html><body><nav>menu</nav><article><h1>T</h1><p>a\n  b&nbsp;c</p><p>d<br>e</p></article><footer>f</footer>", "T\na b c\nd e"),
        ("<article><p>one<p>two<b>bold</b> x</article>", "one\ntwobold x"),
        ("<nav><ul><li>left open<article><p>kept</p></article>", "kept"),
        ("<div class='ad box'>buy</div><p>kept</p><div id=cookie-notice>ok?</div>", "kept"),
        ("<article><p>kept</p><section class=\"comments\"><article class='comment'><p>reader</p></article></section></article>", "kept"),
        ("<body><script>var a='</p>';</script><style>p{}</style><!-- x --><p>k &#233; &lt;b&gt;</p><form>f</form><aside>s</aside>", "k é <b>"),
        ("<p>unclosed <b>tag", "unclosed tag"),
        ("<article>text <div>inner</div> tail</article>", "text\ninner\ntail"),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("<p>x</p><!-- never closed <p>y</p>", "x"),
        ('<div role="navigation">n</div><main><p>m</p></main><p>outside</p>', "m"),
        ("<article><p class=\"social-history\">y</p><p title='a > b'>z</p></article>", "y\nz"),
        ('<article><p>one</p><p>two</p><p title="x<y">three</p></article>', "one\ntwo\nthree"),
        ("<p title='a <b> \"c\"' data-x=1>q</p><p title=\"never closed>r</p>", "q\nr"),
        ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p></article>", "let x=2 be"),
        ('<article><section class="related-work"><p>prior</p></section><section class="discussion"><p>own</p></section></article>', "prior\nown"),
        ('<article><p>k</p><div class="reply"><p>r</p></div><div class="discussion"><p>d</p></div><ul class="comment-list"><li>c</li></ul><div class="siteFooter">f</div></article>', "k"),
        ("<article><p>k</p><section><h2>What readers say</h2><article><p>me too</p></article></section></article>", "k\nWhat readers say"),
        ('<div class="topbar">t</div><div id="header">h</div><p>k</p><div class="header-image-theory">i</div>', "k\ni"),
        ('<div class="x9"><a href="/1">one</a> | <a href="/2">two</a> | <a href="/3">three</a></div><p>see <a href="/4">that</a> page</p>', "see that page"),
        ('<article><ul><li><a href="/1">ref one</a></li><li><a href="/2">ref two</a></li><li><a href="/3">ref three</a></li></ul></article>', "ref one\nref two\nref three"),
        ("</div></p>" * 3 + "<div>a" * 3, "a\na\na"),
    ],
)
def test_article_text(html, want):
    assert text_of(html) == want


def test_templates_are_counted_per_host(spark, work):
    box = "<div class='x1'><p>Read our newsletter and more</p></div>"
    pages = [(k, f"http://h.example/{k}", f"<body>{box}<p>page {k}</p><p>said often</p></body>") for k in range(20)]
    pages += [(100 + k, f"http://other.example/{k}", f"<body>{box}<p>page {k}</p></body>") for k in range(3)]
    pages += [(200, None, f"<body>{box}</body>"), (201, "http://h.example/n", None), (202, "http://h.example/e", "")]
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, hashes int, host string")
    got = {r.page_id: r for r in html_text.extract(df, work).collect()}
    assert got[3].text == "page 3"
    assert got[101].text == "Read our newsletter and more\npage 1"  # too few pages for a template
    assert (got[200].text, got[201].text, got[202].text) == ("Read our newsletter and more", "", "")
    assert (got[3].hashes, got[3].host) == (1, "x")


def test_copied_articles_are_no_templates(spark, work):
    df = spark.createDataFrame([(k, f"http://h.example/{k}", "<body><nav><ul><li>m</li></ul></nav><article><h1>T</h1><p>same text</p></article></body>") for k in range(30)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(df, work).collect()} == {"T\nsame text"}


def test_a_notice_of_one_section_of_a_large_host(spark, work):
    """Without any telling name, on a third of a host's pages; what as many articles hold stays."""
    box = "<div class='zq'><p>Our offices are closed on Monday</p></div>"
    held = "<div class='zq2'><p>a table that many articles show</p></div>"
    pages = [(k, f"http://large.example/{k}", f"<body>{box if k % 3 == 0 else ''}<article><p>page {k}</p>{held if k % 3 == 0 else ''}</article></body>") for k in range(3000)]
    pages += [(10_000 + k, f"http://large.example/x{k}", f"<body>{box if k % 3 == 0 else ''}<p>bare {k}</p></body>") for k in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df, work).collect()}
    assert got[3] == "page 3\na table that many articles show"
    assert (got[10_000], got[10_001]) == ("bare 0", "bare 1")
    assert html_text.extract(df.limit(0), work).count() == 0


def test_many_templates_are_joined_by_salt(spark, work, monkeypatch):
    monkeypatch.setattr(html_text, "BROADCAST_HASHES", 0)
    box = "<div class='x1'><p>Read more</p></div>"
    pages = [(k, f"http://h.example/{k}", f"<body>{box}<p>page {k}</p></body>") for k in range(40)] + [(3, "http://h.example/3", f"<body>{box}<p>page 3</p></body>"), (99, None, None)]
    got = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), work).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted([(k, f"page {k}") for k in range(40)] + [(3, "page 3"), (99, "")])


def test_a_very_long_page():
    whole = "<article>" + "".join(f"<div><p>part {k}" for k in range(60_000)) + "</i></section>" * 60_000
    assert text_of(whole) == "\n".join(f"part {k}" for k in range(60_000))


def independent_text(source):
    """The article's blocks by the standard library's parser: another tokenizer, and a stack of its own."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.blocks, self.text = [], [], ""

        def cut(self):
            if "article" in self.stack and not {"nav", "script", "style", "footer", "aside", "form"} & set(self.stack):
                self.blocks.append(" ".join(self.text.split()))
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag in ("p", "h1", "h2", "ul", "li", "article", "div", "nav", "footer", "body"):
                self.cut()
            if tag == "article":
                self.stack = [t for t in self.stack if t not in ("nav", "ul", "li")]
            if tag == "br":
                self.text += " "
            elif tag != "meta":
                self.stack.append(tag)

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "h2", "ul", "li", "article", "div", "nav", "footer", "body"):
                self.cut()
            if tag in self.stack:
                del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]

        def handle_data(self, data):
            self.text += data

    reader = Reader()
    reader.feed(source or "")
    reader.close()
    return "\n".join(b for b in reader.blocks if b)


def test_the_query_against_an_independent_parser(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = html_text.op1_html_text(spark, "/root/testdata/sf0.01").collect()
    assert {r.page_id: r.text for r in rows} == {i: independent_text(h) for i, h in pages.items()}
    assert all(r.n_chars == len(r.text) for r in rows)


# --- decontamination


def best_distance(item, text):
    """Smallest edit distance of item to a stretch of text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for a in item:
        before, row = row, [row[0] + 1]
        for j, b in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
    return min(row)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        item, text = [rng.randrange(4) for _ in range(rng.randint(1, 70))], [rng.randrange(4) for _ in range(rng.randint(0, 90))]
        assert decontaminate.edit_distance(item, text) == best_distance(item, text)


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = words(rng, 400)
    items = [(k, [rng.choice(vocabulary) for _ in range(rng.randint(6, 70))]) for k in range(30)]
    docs, planted = [], defaultdict(set)
    for d in range(150):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        if d % 2:
            k, item = rng.choice(items)
            copy = list(item)
            for _ in range(rng.randint(0, int(len(item) * 0.15))):
                place = rng.randrange(len(copy))
                if rng.random() < 0.4:
                    copy[place] = rng.choice(vocabulary)
                elif rng.random() < 0.5:
                    copy.insert(place, rng.choice(vocabulary))
                elif len(copy) > 1:
                    del copy[place]
            cut = rng.randint(0, len(text))
            text[cut:cut] = [w.upper() if rng.random() < 0.2 else w + rng.choice(("", ",", "!")) for w in copy]
        docs.append((d, " ".join(text)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(98, None), (99, "too short"), (None, "no id at all for this item")], "item_id long, text string")
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs] + [(500, None, 1), (501, "", 1)], "doc_id long, text string, distance int")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(frame, bench).collect()}
    for d, text in docs:
        tokens = [w.strip(",!").lower() for w in text.split()]
        for k, item in items:
            distance = best_distance(item, tokens)
            if distance <= decontaminate.allowed_edits(len(item)):
                planted[d].add((k, distance))
    want = {(d, k): n for d, found in planted.items() for k, n in found}
    assert set(got) <= set(want)  # nothing that isn't a leak
    assert len(got) >= 0.95 * len(want)
    assert all(n <= want[pair] + 2 for pair, n in got.items())
    light = {p for p, n in want.items() if n == 0}
    assert light <= set(got)
    kept = {r.doc_id for r in decontaminate.without_leaks(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got} | {500, 501}


@pytest.mark.parametrize("kind", ["even", "substitute", "insert", "delete", "mixed"])
def test_recall_at_the_limit_of_edits(kind):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    found = tried = 0
    for n, of in ((15, 100), (20, 100), (40, 100), (59, 100), (120, 100), (256, 100), (400, 60), (1000, 40)):
        items, texts = [], []
        for k in range(of):
            item = [word() for _ in range(n)]
            copy, edits = list(item), decontaminate.allowed_edits(n)
            for j in range(edits):
                do = rng.choice(("substitute", "insert", "delete")) if kind == "mixed" else kind
                place = int((j + 0.5) * n / edits) if do == "even" else rng.randrange(len(copy))
                if do == "insert":
                    copy.insert(place, word())
                elif do == "delete":
                    del copy[place]
                else:
                    copy[place] = word()
            items.append((k, " ".join(item)))
            texts.append(" ".join([*(word() for _ in range(40)), *copy, *(word() for _ in range(40))]))
        hits = decontaminate.Index(items).hits(decontaminate.batch_word_hashes(texts))
        here = sum(k in h for k, h in enumerate(hits))
        assert here >= 0.95 * of  # at every size
        found, tried = found + here, tried + of
    assert found >= decontaminate.TARGET_RECALL * tried


def test_a_long_item_costs_short_texts_nothing():
    rng = random.Random(17)
    vocabulary = [f"v{k}" for k in range(5000)]
    item = [rng.choice(vocabulary) for _ in range(8000)]
    ix = decontaminate.Index([(1, " ".join(item)), (2, " ".join(item[:30]))])
    assert ix.gap <= 2 * decontaminate.LONGEST
    edge = item[30:7990]  # starts and ends within the item, at both ends of its text
    texts = ["no such thing here", " ".join(edge), " ".join(item[:28]), "x " * 50 + " ".join(item), " ".join(item[-2000:])]
    hits = ix.hits(decontaminate.batch_word_hashes(texts))
    assert [set(h) for h in hits] == [set(), {0}, {1}, {0, 1}, set()]
    assert hits[1][0] == 40


def test_leaks_keep_large_ids_beside_null_ones(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    top = (1 << 63) - 1
    docs = spark.createDataFrame([(top, text), (None, text), (top - 2, "nothing to see"), (top - 1, text)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(top - 7, text)], "item_id long, text string")
    assert {tuple(r) for r in decontaminate.leaks(docs, bench).collect()} == {(i, top - 7, 0, 12) for i in (top, None, top - 1)}


def test_short_items_are_found():
    items = [(0, "solo"), (1, "two words"), (2, "It is here, now!"), (3, "a b c d e"), (4, "..."), (5, "a b c d e f g")]
    texts = ["a solo act", "two words", "two more words", "well it is HERE now then", "it is now here", "a b x d e", "a b d e", "a b c c d e", "x b c d y", "", "a b c d e f g"]
    ix = decontaminate.Index(items)
    hits = ix.hits(decontaminate.batch_word_hashes([decontaminate.normalised(t) for t in texts]))
    got = [{ix.ids[k]: d for k, d in h.items()} for h in hits]
    assert got == [{0: 0}, {1: 0}, {}, {2: 0}, {}, {3: 1}, {3: 1}, {3: 1}, {}, {}, {3: 0, 5: 0}]


def test_leaks_in_item_blocks(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    assert whole
    assert sorted(map(tuple, decontaminate.leaks(docs, bench, block=7).collect())) == whole
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0


# --- chat formatting


def test_rotation(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 70, "ann", "é"), (2, 0, None, "x"), (None, 0, "ann", "n"), (1, 1, "ann", "hi <|im_end|>"), (3, None, "zoe", "q")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    got = {(r.conv_id, r.perspective, r.part): r for r in chat_format.rotations(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "ann", 1), (1, "bob", 1), (2, "unknown", 0), (None, "ann", 0), (3, "zoe", -1)}
    a = got[1, "ann", 0]
    assert a.text == "<|im_start|>system\ns<|im_end|>\n" + 2 * "<|im_start|>assistant\nhi < |im_end|><|im_end|>\n" + "<|im_start|>user name=bob\n<|im_end|>\n"
    assert [a.text[x:y] for x, y in zip(a.mask_starts, a.mask_ends, strict=True)] == 2 * ["hi < |im_end|><|im_end|>"]
    assert got[1, "bob", 1].mask_starts == []
    b = got[1, "ann", 1]
    assert [b.text[x:y] for x, y in zip(b.mask_starts, b.mask_ends, strict=True)] == ["é<|im_end|>"]
    assert chat_format.rotations(df.limit(0)).count() == 0
    assert (a.offset, b.offset) == (0, len(a.text))


def test_pieces_are_the_whole_rendering(spark):
    rows = [(1, t, r, f"m{k}") for k, (t, r) in enumerate([(None, "ann"), (None, "bob")] * 5 + [(5, "bob")] * 7 + [(6, "ann"), (200, "bob"), (201, "system")])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.perspective: r for r in chat_format.rotations(df.where("turn IS NULL")).collect()}
    got = sorted((r.perspective, r.part, r.piece, r) for r in chat_format.rotations(df, piece=3).collect())
    assert max(r.n_turns for *_, r in got) == 3
    for who in ("ann", "bob"):
        mine = [r for p, *_, r in got if p == who]
        text = "".join(r.text for r in mine)
        assert text.startswith(whole[who].text)
        assert [text[r.offset : r.offset + len(r.text)] for r in mine] == [r.text for r in mine]
        masks = [text[r.offset + x : r.offset + y] for r in mine for x, y in zip(r.mask_starts, r.mask_ends, strict=True)]
        assert sorted(masks) == sorted(f"{m}<|im_end|>" for _, _, s, m in rows if s == who)


# --- token counts



@pytest.fixture(scope="module")
def vocabulary(tmp_path_factory):
    """A file of ranks with the bytes and a few longer tokens."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"ba", b" a", b"abab", "ü".encode()]
    path = tmp_path_factory.mktemp("ranks") / "tiny.ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {k}\n" for k, t in enumerate(tokens)))
    return str(path)


def counted(spark, work, tokenizer, eod, block):
    rng = random.Random(3)
    top = (1 << 63) - 1
    texts = [" ".join(words(rng, rng.randint(0, 40))) for _ in range(60)] + [None, "", "a<|endoftext|>b", "日本語 ünï", "ab" * 20_000]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "x", 1), (3, texts[3], 1), (top, "last", 1)], "doc_id long, text string, first int").repartition(3)
    flat = token_counts.write_flat(df, work, tokenizer, eod, block_tokens=block)
    tool = token_counts.load_tokenizer(tokenizer)
    want = Counter((i, len(tool.encode_ordinary(t or ""))) for i, t in [(r.doc_id, r.text) for r in df.collect()])
    order = flat.where("payload IS NULL").select("file", "first", F.posexplode("doc_ids").alias("pos", "doc_id")).selectExpr("file", "first + pos AS ordinal", "doc_id")
    got = order.join(token_counts.scan(flat.where("payload IS NOT NULL"), eod, token_counts.id_kind(tokenizer, eod)), ["file", "ordinal"]).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(df.limit(0), work, tokenizer, eod).count() == 0


@pytest.mark.parametrize(("eod", "block"), [(300, token_counts.BLOCK_TOKENS), (300, 5), (70_000, 7)])
def test_token_counts(spark, work, vocabulary, eod, block):
    assert token_counts.id_kind(vocabulary, eod) == ("<u2" if eod == 300 else "<u4")
    counted(spark, work, vocabulary, eod, block)


@pytest.mark.skipif(not os.path.exists(token_counts.TOKENIZER), reason="no tokenizer file")
def test_token_counts_of_the_query(spark, work):
    counted(spark, work, token_counts.TOKENIZER, token_counts.EOD, 1000)


def files_found(blocks, eod, kind):
    found = defaultdict(list)
    for r in sorted(token_counts.scan(blocks, eod, kind).collect(), key=lambda r: (r.file, r.ordinal)):
        found[os.path.basename(r.file)].append((r.ordinal, r.n_tokens, r.closed))
    return found


@pytest.mark.parametrize("block_bytes", [2, 7, 1000])
def test_scan_of_files_made_elsewhere(spark, work, tmp_path, block_bytes):
    streams = {"a": [5, 6, 9, 9, 7, 9], "b": [9], "c": [1, 2, 3], "d": [1, 9, 2, 2]}
    for name, ids in streams.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "e").write_bytes(b"")
    found = files_found(token_counts.flat_blocks(spark, str(tmp_path), work, 9, "<u2", block_bytes), 9, "<u2")
    assert found == {"a": [(0, 2, True), (1, 0, True), (2, 1, True)], "b": [(0, 0, True)], "c": [(0, 3, False)], "d": [(0, 1, True), (1, 2, False)]}


@pytest.mark.parametrize(("kind", "eod"), [("<u2", 50256), ("<u4", 100_257), ("<u2", 0x8181)])
def test_a_file_is_read_by_many_splits(spark, work, tmp_path, kind, eod):
    rng = np.random.RandomState(5)
    ids = rng.randint(0, 60_000, 30_000)
    ids[rng.randint(0, len(ids), 200)] = eod
    ids[[0, 1]] = eod
    (tmp_path / "big").write_bytes(ids.astype(kind).tobytes())
    at = np.flatnonzero(ids == eod)
    want = [(k, int(n), True) for k, n in enumerate(np.diff(np.concatenate([[-1], at])) - 1)]
    if len(ids) - 1 > at[-1]:
        want.append((len(at), int(len(ids) - 1 - at[-1]), False))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3001b")
    try:
        found = files_found(token_counts.flat_blocks(spark, str(tmp_path), work, eod, kind, 777), eod, kind)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {"big": want}


# --- quality


def chain_brute(score, moves):
    import itertools

    weights = Counter()
    for states in itertools.product((0, 1), repeat=len(score)):
        w = sum(s * x for s, x in zip(states, score, strict=True)) + sum(moves[a][b] for a, b in itertools.pairwise(states))
        for k, s in enumerate(states):
            weights[k] += s * np.exp(w)
        weights["all"] += np.exp(w)
    return [weights[k] / weights["all"] for k in range(len(score))]


def test_marginals_by_enumeration():
    rng = np.random.RandomState(4)
    lines_of = np.array([1, 5, 3, 7])
    score, moves = rng.randn(16), rng.randn(2, 2)
    got, _ = quality.marginals(score, lines_of, moves)
    low = 0
    for n in lines_of:
        assert got[low : low + n] == pytest.approx(chain_brute(score[low : low + n], moves))
        low += n


def test_line_counts_across_slices(monkeypatch):
    texts = ["Ab c.\n\n!!x|", None, "", "é1\n", "a" * 50]
    whole, lines = quality.line_counts(texts)
    monkeypatch.setattr(quality, "SLICE", 3)
    part, again = quality.line_counts(texts)
    assert (whole == part).all()
    assert lines.tolist() == again.tolist() == [3, 1, 1, 2, 1]
    assert whole[0].tolist() == [2, 1, 0, 1, 1, 0, 0, 0, 0, 0, 2]
    assert whole[2].tolist() == [1, 0, 0, 0, 2, 0, 1, 0, 0, 1, 1]


def test_quality_separates_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in quality.op5_quality(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    good = [rows[r.doc_id].score for r in labels if r.quality == 1]
    bad = [rows[r.doc_id].score for r in labels if r.quality == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in labels]) > 0.95
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_quality_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "fine words here"), (2, "")], "doc_id long, text string")
    none = quality.train(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert none is None
    assert {r.score for r in quality.scored(df, none).collect()} == {0.5}
    assert quality.scored(df.limit(0), none).count() == 0


def test_the_fit_takes_long_texts_and_a_doc_id_once(spark, monkeypatch):
    """Long texts are fitted on, within the lines allowed in all; repeated rows don't push others out."""
    good, bad = "\n".join(["A fine line of plain words."] * 600), "\n".join(["$$$ 99 ||| BUY!!! 00"] * 600)
    docs = [(k, good if k % 2 else bad) for k in range(40)] + [(k, bad) for k in (0, 2, 4) for _ in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(0, 0)] * 100, "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda counts, lines_of, q: seen.append((len(counts), lines_of.tolist(), q.tolist())))
    quality.train(frame, labels)
    n, lines_of, q = seen.pop()
    assert n == sum(lines_of) == 600 * len(q)
    assert {0, 1} == set(q)
    assert len(q) > 25  # all that aren't held out
    quality.train(frame, labels, lines=1900)
    assert seen.pop()[1] == [600] * 3
    quality.train(frame, labels, lines=100)
    assert seen.pop()[1] == [600]
    monkeypatch.undo()
    texts = [good, bad, good[:10_000] * 3, "", None]
    scores = quality.score_texts(texts, quality.train(frame, labels))
    assert scores[0] == pytest.approx(scores[2], abs=0.05) and scores[0] > 0.9 > 0.1 > scores[1]


# --- mixing


def water_levels(sizes, cap=3):
    """source -> target, by filling up again and again."""
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, full = sum(sizes.values()), {}
    while True:
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / sum(w for q, w in weight.items() if q not in full) for s in weight if s not in full}
        over = [s for s in share if share[s] > cap * sizes[s]]
        if not over:
            return {**share, **full}
        full |= {s: cap * sizes[s] for s in over}


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(6)
    rows = []
    for k in range(900):
        source = rng.choices(["a", "b", "é", "Z", None, "tiny", "empty"], [30, 10, 10, 20, 5, 0.5, 2])[0]
        rows.append((k, source, "" if source == "empty" else " ".join(words(rng, rng.choice((0, 3, 50, 400))))))
    rows += [(None, "a", "x y"), (5000, "b", None), (1, rows[1][1], rows[1][2])]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")


def test_mix(spark, mixed, work):
    got = source_mix.mix(mixed, work).collect()
    again = source_mix.mix(mixed.repartition(7), Work(spark)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    rows = mixed.collect()
    assert len(got) == len(rows)
    sizes = Counter({r.source: 0 for r in rows})
    for r in rows:
        sizes[r.source] += len((r.text or "").split())
    want, taken = water_levels(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(0.03 * target, 2 * source_mix.BLOCK)
    assert source_mix.mix(mixed.limit(0), work).count() == 0


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 100):
        rows = spark.range(n).selectExpr("id", "3 AS s", "0 AS t", f"{n}L AS n").selectExpr(source_mix.permuted("s", "t", "n", "id") + " AS p").collect()
        assert sorted(r.p for r in rows) == list(range(n))
        if n == 100:
            assert [r.p for r in rows] != list(range(n))


# --- all together


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    compare(spark, con, SF, queries.queries()[name], queries.oracle_sql()[name])


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, work = [docs], Work(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = work.save(stage(spark, seen[-1], SF), "stage")
        assert kept.columns == docs.columns
        seen.append(kept)
    n = [d.count() for d in seen]
    assert n[0] > n[1] == n[2] >= n[3] >= n[4] > 0.5 * n[0]
    last = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF)
    assert last.count() == n[4]
    assert corpus_pipeline.run(spark, SF).count() == n[4]


def test_pipeline_of_odd_rows(spark):
    """Null, empty, repeated and shared rows, and columns whose names are used inside; no text is lost that nothing stands for."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    given = spark.read.parquet(f"{SF}/documents.parquet")
    top = (1 << 63) - 1
    texts = [r.text for r in given.orderBy("doc_id").limit(60).collect()]
    t, u = [x for x in texts if len(x.split()) > 80][:2]
    odd = [(3_000_001, t), (3_000_002, t), (3_000_002, u), (3_000_003, u), (top, u), (None, None), (None, ""), (None, t), (3_000_004, None), (3_000_004, None), (3_000_005, "")]
    rows = [(k, x) for k, x in enumerate(texts)] + odd + odd[:2]
    frame = spark.createDataFrame([(i, x, "en", "s", len(x or ""), 1, 2, 3) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long, rep long, comp long, __row long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns, name
        assert stage(spark, frame.limit(0), SF).count() == 0, name
    kept = [r.text for r in corpus_pipeline.drop_near_copies(spark, frame, SF).collect()]
    sets = [set(zip(*[x.split()[k:] for k in range(5)], strict=False)) for x in kept if x]
    for x in texts + [t, u]:
        mine = set(zip(*[x.split()[k:] for k in range(5)], strict=False))
        assert not mine or any(len(mine & s) >= 0.4 * len(mine | s) for s in sets)  # itself, or what it is linked with
    assert sum(x == t for x in kept) <= 1 and sum(x == u for x in kept) <= 1
    assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == len(rows)
