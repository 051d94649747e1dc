"""HTML extraction with site template removal.

Pages are parsed twice in map-only passes. The first hashes the subtree of every block element (tag, class, id,
text and children); the hashes are counted per host in Spark, once a page, and those on many pages of a host are its
templates: on MIN_PAGES pages, and on half of the host's pages or, outside articles, on GROWTH times the root of
their number, if that is less, so that a notice of one section of a large host counts. A page has a bounded number
of elements, so a host's list grows with that root at most. The second pass deletes template subtrees and what is
boilerplate by its element, its role, an article within an article (reader comments, in HTML's own terms), a name that
consists of nothing but words for boilerplate, or, outside articles, by being made of links; it returns the article's
blocks. Prose inside an article (paragraphs, headings, list items) is never a template: an article that many pages
repeat stays.

Only hashes are shuffled, pre-aggregated by host, so a host with a third of all pages is spread over all tasks;
the templates are broadcast while they are few (a checked count); beyond it they and the pages are joined by host and a
salt.

Edge cases: null or empty html gives an empty text. A null or odd url has no host and no templates. Unclosed
elements end where their parent ends, comments and scripts without an end run to the page's end; an attribute value
ends at its quote, whatever it holds. A page of any length is parsed in one pass; it needs some times its size in
memory. Repeated rows count as pages of their own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import Work, read_table

MIN_PAGES = 10
SHARE = 0.5
GROWTH = 10
#: Hashes (8 bytes each) that may be broadcast, and parts of a host's pages beyond that.
BROADCAST_HASHES = 2_000_000
SALTS = 32
#: Outside articles, an element with so many links that hold this share of its text is a menu.
MENU_LINKS, MENU_SHARE = 3, 0.8

_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt figcaption td th tr tbody thead tfoot".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg select button canvas object audio video".split())
_BOILER = frozenset("nav footer aside form menu dialog head".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words for boilerplate in class names and ids; a name counts if it has one and consists of such and of neutral ones.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle breadcrumb breadcrumbs comment commentlist comments consent cookie"
    " cookies disqus footer gdpr login menu menus modal modals nav navbar navigation newsletter newsletters notice notices pager pagination paginator"
    " popup popups promo promos recommended related replies reply respond share sharing sidebar sidebars signin signup social sponsor sponsored"
    " subscribe subscription toolbar widget widgets".split()
)
#: The same outside articles, where a head isn't the article's own.
_OUTER_NAMES = _NAMES | frozenset("banner discussion header masthead search topbar".split())
_NEUTRAL = frozenset(
    "area article articles bar block blocks body bottom box boxes button buttons col column container content count desktop fixed floating form global"
    " group heading holder icon icons inner item items latest left link links list lists main mobile module new outer page panel post posts primary reader"
    " readers region right row secondary section site slot small sticky text thread title top unit user users wrap wrapper zone".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>", re.S
)
_MARKS = re.compile(r"[\W_]+")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: What a new element of the first kind ends, if open and innermost among blocks.
_ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}


@lru_cache(maxsize=1 << 16)
def boilerplate_names(names: str, in_article: bool, tag: str) -> bool:
    """Whether one of the class names and ids, by its words, is for boilerplate."""
    listed = _NAMES if in_article else _OUTER_NAMES
    for name in names.split():
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if any(w in listed for w in words) and all(w in listed or w in _NEUTRAL for w in words):
            return True
        if in_article and words == ["discussion"] and tag != "section":  # a section may be the article's own
            return True
    return False


def host_of(url: str | None) -> str | None:
    found = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return found[1].lower() if found else None


class _Element:
    __slots__ = ("tag", "label", "first", "children", "skip", "article", "main", "chars", "linked", "links")

    def __init__(self, tag, label, first, skip, article, main):
        self.tag, self.label, self.first, self.skip, self.article, self.main = tag, label, first, skip, article, main
        self.children: list[str] = []
        self.chars = self.linked = self.links = 0


class Page:
    """One pass over a page: blocks of text, and the hashes of its block elements (odd ones are inside an article)."""

    def __init__(self, source: str, templates: frozenset = frozenset()):
        self.templates, self.hashes = templates, set()
        self.blocks: list[tuple[str, int]] = []  # text and rank: 2 in an article, 1 in main, 0 elsewhere
        self.run: list[str] = []
        self.linked = self.links = 0
        self.in_link = False
        self.open = [_Element("", "", 0, False, False, False)]
        self.count: Counter = Counter()
        self.parse(source)

    def text(self) -> str:
        best = max((rank for _, rank in self.blocks), default=0)
        return "\n".join(t for t, rank in self.blocks if rank == best)

    def flush(self) -> None:
        if self.run:
            text = " ".join(markup.unescape("".join(self.run)).split())
            self.run.clear()
            if text:
                top = self.open[-1]
                top.children.append(text)
                if not top.article:
                    chars = len(_MARKS.sub("", text))
                    top.chars += chars
                    top.linked += min(self.linked, chars)
                    top.links += self.links
                if not top.skip:
                    self.blocks.append((text, 2 if top.article else 1 if top.main else 0))
        self.linked = self.links = 0

    def start(self, tag: str, attributes: str) -> None:
        self.flush()
        if tag == "article" or tag == "main":  # these can't stand in a menu that was left open
            while len(self.open) > 1 and self.open[-1].skip and self.open[-1].label == self.open[-1].tag:
                self.end_top()
        ends = _ENDS.get(tag, {"p"})
        while self.open[-1].tag in ends:
            self.end_top()
        top = self.open[-1]
        label, skip = tag, top.skip
        role = None
        if attributes.strip():
            named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            role = named.get("role", "").lower()
            names = f"{named.get('class', '')} {named.get('id', '')}".strip()
            label = f"{tag} {names}" if names else tag
            skip = skip or "hidden" in named or role in _BOILER_ROLES
            skip = skip or tag not in ("body", "html", "article", "main") and boilerplate_names(names, top.article, tag)
            skip = skip or tag == "article" and bool(re.search(r"(?i)\bcomment", names))
        skip = skip or tag in _BOILER or tag == "header" and not top.article or tag == "article" and top.article
        self.open.append(_Element(tag, label, len(self.blocks), skip, top.article or tag == "article", top.main or tag == "main" or role == "main"))
        self.count[tag] += 1

    def end_top(self) -> None:
        self.flush()
        done = self.open.pop()
        self.count[done.tag] -= 1
        up = self.open[-1]
        up.chars, up.linked, up.links = up.chars + done.chars, up.linked + done.linked, up.links + done.links
        digest = xxhash.xxh64_intdigest("\x1f".join([done.label, *done.children]).encode("utf-8", "surrogatepass")) >> 1
        up.children.append(f"\x1e{digest}")
        whole = done.tag in ("html", "body", "article", "main")
        if done.children and not whole and not (done.article and done.tag in _PROSE):
            digest = digest & ~1 | done.article
            self.hashes.add(digest)
            menu = not done.article and done.links >= MENU_LINKS and done.linked >= MENU_SHARE * done.chars
            if menu or digest in self.templates:
                del self.blocks[done.first :]

    def end(self, tag: str) -> None:
        self.flush()
        while self.count[tag]:
            last = self.open[-1].tag
            self.end_top()
            if last == tag:
                return

    def parse(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            token = _TOKEN.search(source, at)
            till = n if token is None else token.start()
            if till > at:
                self.run.append(source[at:till])
                if self.in_link:
                    self.linked += len(_MARKS.sub("", source[at:till]))
            if token is None:
                break
            at = token.end()
            if token[2] is None:
                continue
            tag = token[2].lower()
            if tag in _RAW:
                if not token[1] and not token[3].endswith("/"):
                    close = re.compile(rf"(?i)</{tag}\b[^>]*>").search(source, at)
                    at = close.end() if close else n
            elif tag in _BLOCKS or tag == "head":
                if tag == "hr":
                    self.flush()
                elif token[1]:
                    self.end(tag)
                else:
                    self.start(tag, token[3])
            elif tag == "br":
                self.run.append(" ")
            elif tag == "a":
                self.in_link = not token[1]
                self.links += self.in_link
            # Other elements are inline: their tags vanish, their text runs on.
        while len(self.open) > 1:
            self.end_top()
        self.flush()


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        hosts = [host_of(u) for u in pdf["url"]]
        found = [sorted(Page(h).hashes) if host and h else [] for host, h in zip(hosts, pdf["html"], strict=True)]
        yield pd.DataFrame({"host": hosts, "hashes": found})


def host_templates(pages: DataFrame, work: Work, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """host, hashes: the subtree hashes that recur across many pages of a host."""
    hashed = work.save(pages.select("url", "html").mapInPandas(_hashes, "host string, hashes array<long>").where("host IS NOT NULL"), "subtrees")
    pages_of = hashed.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    counted = hashed.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    part = F.when(F.col("hash") % 2 == 1, share * F.col("pages")).otherwise(F.least(share * F.col("pages"), GROWTH * F.sqrt("pages")))
    many = counted.join(pages_of, "host").where(F.col("n") >= part)
    return work.save(many.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("hashes")), "templates")


@F.pandas_udf(StringType())
def article_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for sources, templates in batches:
        out = [Page(s or "", frozenset(t.tolist()) if t is not None else frozenset()).text() for s, t in zip(sources, templates, strict=True)]
        yield pd.Series(out, index=sources.index)


@F.pandas_udf(StringType())
def host_column(urls: pd.Series) -> pd.Series:
    return urls.map(host_of)


def extract(pages: DataFrame, work: Work) -> DataFrame:
    """pages (url, html and others) with text."""
    templates = host_templates(pages, work)
    named = templates.select(F.col("host").alias("__host"), F.col("hashes").alias("__templates"))
    hosted = pages.withColumn("__host", host_column("url"))
    if (templates.agg(F.sum(F.size("hashes"))).first()[0] or 0) <= BROADCAST_HASHES:
        marked = hosted.join(F.broadcast(named), "__host", "left")
    else:  # a host's pages go to SALTS tasks
        salted = named.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = hosted.withColumn("__salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["__host", "__salt"], "left").drop("__salt")
    return marked.withColumn("text", article_text("html", "__templates")).drop("__host", "__templates")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, Work(spark)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
