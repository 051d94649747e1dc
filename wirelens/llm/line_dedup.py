"""Line dedup by content-defined chunks of lines.

The lines of a text are hashed; a rolling hash over two neighbouring line hashes chooses the chunk boundaries,
so that lines inserted or deleted elsewhere don't move them. A chunk of two lines or more that aren't blank,
which occurs again anywhere in the corpus, stays at its first place (smallest doc_id, then first in the text) and
is removed elsewhere, after its bytes were compared with those of the place that stays. Chunks of one line, and
everything that occurs once, stay untouched. That is op9_line_dedup, as its SQL states it: a repeated passage whose
lines fall into chunks of one line, or into chunks with lines of their surroundings, stays in part or whole.

dedup_passages, which the pipeline uses, takes the same chunks out, and then what their boundaries miss: of the other
lines, every two neighbouring ones that aren't blank, with the blank ones between, are looked for too, with one line in
a removed chunk or none. So every line of every passage of two lines or more which stands at an earlier place is removed. A line's text stays at its first place at least. Places that overlap the
first place of the same two lines (a line repeated at once) aren't repetitions.

What moves: first a hash for each chunk; then, for repeated hashes only, their bytes; at last each text that
loses lines. Everything is DataFrame functions.

Edge cases: a null text stays null and has no lines; an empty text has one empty line, which isn't a chunk of its
own. Fully repeated rows (same doc_id, same text) are one document and get the same result. A null doc_id comes
after all others. Further columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Work, read_table

#: A chunk ends after a line at which the first hexadecimal digit of the rolling hash is below this.
BOUNDARY_BELOW = "6"
MIN_LINES = 2


def with_chunks(docs: DataFrame, boundary_below: str = BOUNDARY_BELOW) -> DataFrame:
    """docs with the columns __chunks: the text's chunks in order, each an array of its lines."""
    return _with_ends(docs, boundary_below).drop("__ends")


def _with_ends(docs: DataFrame, boundary_below: str = BOUNDARY_BELOW) -> DataFrame:
    """with_chunks, and __ends: the number of each chunk's last line."""
    lines = docs.withColumn("__lines", F.split("text", "\n", -1))
    hashed = lines.withColumn("__h", F.transform("__lines", lambda x: F.md5(x)))
    ends = hashed.withColumn(
        "__ends",
        F.expr(
            f"""filter(transform(__h, (x, k) -> CASE WHEN k = size(__h) - 1
                       OR substring(md5(concat(CASE WHEN k > 0 THEN __h[k - 1] ELSE '' END, x)), 1, 1) < '{boundary_below}'
                       THEN k ELSE -1 END), k -> k >= 0)"""
        ),
    )
    return ends.withColumn(
        "__chunks",
        F.expr(
            """transform(__ends, (e, k) -> slice(__lines, CASE WHEN k = 0 THEN 1 ELSE __ends[k - 1] + 2 END,
                                                 CASE WHEN k = 0 THEN e + 1 ELSE e - __ends[k - 1] END))"""
        ),
    ).drop("__lines", "__h")


def chunk_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each chunk: keep, no, solid (lines that aren't blank), body."""
    # Outer: an inner explode infers a filter on the array, which would be pushed below, with all that makes the
    # array written out again inside its own lambdas.
    rows = with_chunks(docs).select(*keep, F.posexplode_outer("__chunks").alias("no", "c")).where("c IS NOT NULL")
    solid = F.size(F.filter("c", lambda x: x.rlike(WORD_PATTERN)))
    return rows.select(*keep, "no", solid.alias("solid"), F.array_join("c", "\n").alias("body"))


def chunk_places(docs: DataFrame, *keep: str) -> DataFrame:
    """chunk_rows of MIN_LINES or more lines that aren't blank; no is the number of the chunk's first line."""
    starts = F.expr("transform(__ends, (e, k) -> CASE WHEN k = 0 THEN 0 ELSE __ends[k - 1] + 1 END)")
    chunks = _with_ends(docs).withColumn("__starts", starts).select(*keep, F.explode_outer(F.arrays_zip("__starts", "__chunks")).alias("c"))
    rows = chunks.where("c IS NOT NULL").select(*keep, F.col("c.__starts").alias("no"), F.col("c.__chunks").alias("c"))
    return rows.where(F.size(F.filter("c", lambda x: x.rlike(WORD_PATTERN))) >= MIN_LINES).select(*keep, "no", F.array_join("c", "\n").alias("body"))


def pair_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for every two neighbouring lines that aren't blank: keep, no (the first one's number), body (both, and what is between)."""
    lines = docs.withColumn("__lines", F.split("text", "\n", -1))
    solid = lines.withColumn("__solid", F.expr(f"filter(sequence(0, size(__lines) - 1), k -> __lines[k] rlike r'{WORD_PATTERN}')"))
    pairs = F.expr(
        """CASE WHEN size(__solid) > 1 THEN transform(sequence(0, size(__solid) - 2), j -> named_struct('no', __solid[j],
                'body', array_join(slice(__lines, __solid[j] + 1, __solid[j + 1] - __solid[j] + 1), '\n'))) END"""
    )
    rows = solid.withColumn("__pairs", pairs).select(*keep, F.explode_outer("__pairs").alias("p")).where("p IS NOT NULL")
    return rows.select(*keep, "p.no", "p.body")


def _place():
    return F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "fp", "no")


def lost_places(docs: DataFrame, work: Work, rows_of: Callable[..., DataFrame], known: DataFrame | None = None) -> DataFrame:
    """doc_id, fp, no, body, first: the rows of rows_of(docs, ...) whose body stands at an earlier place, `first`.

    known: doc_id, fp, no of rows that are left out; none of them may be a first place.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("fp"), "text")
    places = rows_of(keyed, "doc_id", "fp").select("doc_id", "fp", "no", F.xxhash64("body").alias("hash")).distinct()
    if known is not None:
        at = [F.col("p.doc_id").eqNullSafe(F.col("k.doc_id")), F.col("p.fp") == F.col("k.fp"), F.col("p.no") == F.col("k.no")]
        places = places.alias("p").join(known.alias("k"), at, "left_anti")
    marks = work.save(places, "marks")
    # Aggregates are written before they are joined: the join's exchanges can then be split where a key is hot.
    again = work.save(marks.groupBy("hash").count().where("count > 1").select("hash"), "again")
    wanted = marks.join(again, "hash").groupBy("doc_id", "fp").agg(F.collect_set("no").alias("nos"))
    same = [F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), F.col("d.fp") == F.col("w.fp")]
    found = keyed.alias("d").join(wanted.alias("w"), same).select("d.doc_id", "d.fp", "d.text", "w.nos")
    bodies = work.save(rows_of(found, "doc_id", "fp", "nos").where(F.array_contains("nos", F.col("no"))).select("doc_id", "fp", "no", "body"), "bodies")
    # The byte comparison: places are grouped by the chunk's text itself, not by its hash.
    firsts = work.save(bodies.groupBy("body").agg(F.min(_place()).alias("first")), "firsts")
    return bodies.join(firsts, "body").where(_place() != F.col("first"))


def lost_chunks(docs: DataFrame, work: Work, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, fp, gone: the numbers of the chunks that a document loses."""
    lost = lost_places(docs, work, lambda d, *keep: chunk_rows(d, *keep).where(F.col("solid") >= min_lines))
    return lost.groupBy("doc_id", "fp").agg(F.collect_set("no").alias("gone"))


def lost_spans(docs: DataFrame, work: Work) -> DataFrame:
    """doc_id, fp, low, high: the lines, from the first to the last one that isn't blank, of chunks which stand at an earlier place."""
    solid = F.expr(f"filter(sequence(0, size(c) - 1), k -> c[k] rlike r'{WORD_PATTERN}')")
    lost = lost_places(docs, work, chunk_places).withColumn("c", F.split("body", "\n", -1)).withColumn("s", solid)
    return lost.select("doc_id", "fp", (F.col("no") + F.element_at("s", 1)).alias("low"), (F.col("no") + F.element_at("s", -1)).alias("high"))


def lost_lines(docs: DataFrame, work: Work) -> DataFrame:
    """doc_id, fp, gone: the numbers of the lines that a document loses by passages which stand at an earlier place."""
    spans = work.save(lost_spans(docs, work), "spans")
    # Pairs inside a lost chunk are lost with it. None is a first place: the chunk's first place has the pair earlier.
    inside = spans.select("doc_id", "fp", F.explode(F.expr("sequence(low, high - 1)")).alias("no"))
    breaks = F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit("")))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("fp") == F.col("first.fp"))
    pairs = lost_places(docs, work, pair_rows, inside).withColumn("breaks", breaks).where(~(own & (F.col("no") <= F.col("first.no") + F.col("breaks"))))
    lost = spans.unionByName(pairs.select("doc_id", "fp", F.col("no").alias("low"), (F.col("no") + F.col("breaks")).alias("high")))
    return lost.groupBy("doc_id", "fp").agg(F.flatten(F.collect_set(F.expr("sequence(low, high)"))).alias("gone"))


def dedup_lines(docs: DataFrame, work: Work, min_lines: int = MIN_LINES) -> DataFrame:
    """docs with the text that is left, and __n_lines and __n_removed: lines before, lines removed."""
    gone = lost_chunks(docs, work, min_lines)
    keyed = docs.withColumn("__fp", F.xxhash64("text"))
    same = [F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), F.col("d.__fp") == F.col("g.fp")]
    joined = keyed.alias("d").join(gone.alias("g"), same, "left").select("d.*", F.col("g.gone").alias("__gone"))
    cut = with_chunks(joined)
    left = F.expr("flatten(filter(__chunks, (c, k) -> NOT array_contains(__gone, k)))")
    # A document that loses all its lines is left with an empty text.
    return (
        cut.withColumn("__left", F.when(F.col("__gone").isNotNull(), left))
        .withColumn("__n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.flatten("__chunks"))).cast("long"))
        .withColumn("__n_removed", F.when(F.col("__gone").isNull(), 0).otherwise(F.col("__n_lines") - F.size("__left")).cast("long"))
        .withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join("__left", "\n")))
        .drop("__fp", "__gone", "__chunks", "__left")
    )


def dedup_passages(docs: DataFrame, work: Work) -> DataFrame:
    """docs without the lines of repeated passages: text, and __n_lines and __n_removed as in dedup_lines."""
    gone = lost_lines(docs, work)
    keyed = docs.withColumn("__fp", F.xxhash64("text"))
    same = [F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), F.col("d.__fp") == F.col("g.fp")]
    cut = keyed.alias("d").join(gone.alias("g"), same, "left").select("d.*", F.col("g.gone").alias("__gone")).withColumn("__lines", F.split("text", "\n", -1))
    left = F.expr("transform(array_except(sequence(0, size(__lines) - 1), __gone), k -> __lines[k])")
    return (
        cut.withColumn("__left", F.when(F.col("__gone").isNotNull(), left))
        .withColumn("__n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).cast("long"))
        .withColumn("__n_removed", F.when(F.col("__gone").isNull(), 0).otherwise(F.col("__n_lines") - F.size("__left")).cast("long"))
        .withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join("__left", "\n")))
        .drop("__fp", "__gone", "__lines", "__left")
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, Work(spark)).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text"
    )


#: chunks: doc_id, no, c (lines); left_over: doc_id, no, c without what is removed.
ORACLE_PARTS = r"""
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM {docs} WHERE text IS NOT NULL),
h AS (SELECT *, list_transform(lines, lambda x: md5(x)) AS h FROM l),
e AS (SELECT *, list_filter(list_transform(range(1, len(h) + 1), lambda k: CASE WHEN k = len(h)
        OR substr(md5(CASE WHEN k > 1 THEN h[k - 1] ELSE '' END || h[k]), 1, 1) < '{below}' THEN k ELSE -1 END), lambda k: k > 0) AS ends FROM h),
c AS (SELECT doc_id, k AS no, lines[(CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END) + 1 : ends[k]] AS c
      FROM (SELECT *, unnest(range(1, len(ends) + 1)) AS k FROM e)),
m AS (SELECT *, array_to_string(c, chr(10)) AS body,
             len(list_filter(c, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) >= {least} AS solid FROM c),
g AS (SELECT *, solid AND row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST, no) > 1 AS gone FROM m)"""
ORACLE = (
    "WITH "
    + ORACLE_PARTS.format(docs="documents", below=BOUNDARY_BELOW, least=MIN_LINES)
    + r"""
SELECT d.doc_id, coalesce(x.n_lines, 0)::BIGINT AS n_lines, coalesce(x.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, sum(len(c)) AS n_lines, sum(CASE WHEN gone THEN len(c) ELSE 0 END) AS n_removed,
         string_agg(body, chr(10) ORDER BY no) FILTER (NOT gone) AS text
  FROM g GROUP BY doc_id) x ON d.doc_id = x.doc_id
"""
)
