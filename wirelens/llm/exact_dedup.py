"""Exact dedup by content-defined chunk recipes.

Texts count as equal when they are identical after deleting white space. One pass over the corpus cuts
each normalised text into content-defined chunks and keeps, per chunk, a 64-bit id and its SHA-256. Chunks
are deduplicated to verified identifiers (an id that stands for two different digests is split), a document
becomes the ordered list of its identifiers, and whole documents are compared by these lists. Long texts are
read once and never shuffled: what moves is about 40 bytes for each chunk of some 500 characters.

Edge cases: a null text counts as empty; all empty texts are one group. A null doc_id loses every tie against
a number. Fully repeated rows are separate rows of one group, of which one stays. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, Work, read_table

#: A piece ends at a sentence mark or after this many characters without one.
PIECE_CHARS = 400
#: A chunk ends after a piece whose rolling hash (over two pieces) is 0 modulo this.
CHUNK_PIECES = 8


def with_recipes(docs: DataFrame, piece_chars: int = PIECE_CHARS, chunk_pieces: int = CHUNK_PIECES) -> DataFrame:
    """rid, doc_id, n_code, text_sha256 and raw: the chunks of the normalised text, array of (id, sha)."""
    piece = f"[^.!?]{{0,{piece_chars}}}[.!?]|[^.!?]{{1,{piece_chars}}}"
    normal = docs.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_code"),
        F.regexp_replace(F.coalesce("text", F.lit("")), f"[{SPACE}]+", "").alias("norm"),
    )
    pieces = normal.select(
        "doc_id", "n_code", F.sha2("norm", 256).alias("text_sha256"), F.regexp_extract_all("norm", F.lit(piece), F.lit(0)).alias("pieces")
    )
    hashed = pieces.withColumn("h", F.transform("pieces", lambda p: F.xxhash64(p)))
    # Position k is an end when the hash of the last two piece hashes says so; the last piece always is one.
    ends = hashed.withColumn(
        "ends",
        F.expr(
            f"""filter(transform(h, (x, k) -> CASE WHEN k = size(h) - 1
                       OR pmod(xxhash64(CASE WHEN k > 0 THEN h[k - 1] ELSE 0 END, x), {chunk_pieces}) = 0 THEN k ELSE -1 END), k -> k >= 0)"""
        ),
    )
    chunks = ends.withColumn(
        "chunks",
        F.expr(
            """transform(ends, (e, k) -> array_join(slice(pieces,
                       CASE WHEN k = 0 THEN 1 ELSE ends[k - 1] + 2 END,
                       CASE WHEN k = 0 THEN e + 1 ELSE e - ends[k - 1] END), ''))"""
        ),
    )
    return chunks.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        "n_code",
        "text_sha256",
        F.expr("transform(chunks, c -> named_struct('id', xxhash64(c), 'sha', unhex(sha2(c, 256))))").alias("raw"),
    )


def verified_identifiers(chunks: DataFrame) -> DataFrame:
    """One row for each distinct chunk: id, sha, and variant, which tells different chunks with one id apart."""
    distinct = chunks.select("id", "sha").distinct()
    return distinct.withColumn("variant", F.row_number().over(Window.partitionBy("id").orderBy("sha")))


def exact_duplicates(docs: DataFrame, work: Work) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text)."""
    signed = work.save(with_recipes(docs), "recipes")
    chunks = signed.select("rid", F.posexplode("raw").alias("pos", "c")).select("rid", "pos", "c.id", "c.sha")
    store = work.save(verified_identifiers(chunks), "store")
    lists = (
        chunks.join(store, ["id", "sha"])
        .groupBy("rid")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "id", "variant"))).alias("recipe"))
        .select("rid", F.expr("transform(recipe, r -> named_struct('id', r.id, 'variant', r.variant))").alias("recipe"))
    )
    nothing = F.expr("cast(array() as array<struct<id:bigint,variant:int>>)")
    rows = work.save(
        signed.drop("raw").join(lists, "rid", "left").withColumn("recipe", F.coalesce("recipe", nothing)), "lists"
    )
    # Written before the join: the plain exchanges that the join then has can be split where a group is large.
    groups = work.save(
        rows.groupBy("recipe").agg(
            F.count(F.lit(1)).alias("group_size"),
            F.min(F.struct((-F.col("n_code")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("id"), F.col("rid").alias("rid"))).alias("best"),
        ),
        "groups",
    )
    return rows.join(groups, "recipe").select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        "text_sha256",
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"), Work(spark))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_code,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_code DESC, doc_id NULLS LAST)
"""
