"""Token counts by a separator scan of flat token files.

A flat token file is a run of little-endian token ids, each document followed by an end-of-document id, with no
index. The scan splits files into blocks wherever they fall, searches each block for the separator with vector
operations, and stitches the blocks of a file together by a prefix scan: the separators before a block number its
documents, and the tokens since the last separator before it belong to its first one.

`write_flat` makes such files of documents: one flat file for each partition, held as a table of fixed-size blocks
on shared storage, with a manifest of the order of its documents. `flat_blocks` reads files made elsewhere, of any size,
by Spark's splits. Ids are 16 bits wide, or 32 where the vocabulary or the separator needs it.

Edge cases: null and empty texts are documents of 0 tokens. The separator's own text inside a document is ordinary
text. Tokens after a file's last separator are one more, open, document. Repeated rows are documents of their
own; a null doc_id stays null. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Work, read_table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are split before they are encoded.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256
BLOCK_TOKENS = 1 << 18

_loaded: dict = {}


def load_tokenizer(path: str):
    """The encoding of a file of ranks (base64 token and rank a line); no special tokens, so all text is ordinary text."""
    if path not in _loaded:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def id_kind(tokenizer: str, eod: int) -> str:
    """How wide an id is stored."""
    return "<u2" if max(load_tokenizer(tokenizer).max_token_value, eod) < 1 << 16 else "<u4"


def encode(tokenizer, texts: list, kind: str = "<u2") -> Iterator[np.ndarray]:
    """The ids of each text, in order; None counts as empty."""
    for text in texts:
        yield np.array(tokenizer.encode_ordinary(text or ""), kind)


def write_flat(docs: DataFrame, work: Work, tokenizer: str = TOKENIZER, eod: int = EOD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, payload rows (flat tokens) and file, first, doc_ids rows (the manifest), as one written table."""

    kind = id_kind(tokenizer, eod)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, first = TaskContext.get().partitionId(), 0, 0
        rest, held = [], 0
        tool = load_tokenizer(tokenizer)

        def cut(final: bool) -> list:
            nonlocal rest, held, block
            stream, rows, at = np.concatenate(rest) if rest else np.zeros(0, kind), [], 0
            while len(stream) - at >= block_tokens or final and at < len(stream):
                rows.append((file, block, stream[at : at + block_tokens].tobytes(), None, None))
                block, at = block + 1, at + block_tokens
            rest, held = [stream[at:]], max(0, len(stream) - at)
            return rows

        def batch_of(rows: list) -> pa.RecordBatch:
            types = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "block", "payload", "first", "doc_ids"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()  # whole numbers: a float would round large ones
            rows = [(file, None, None, first, ids)]
            first += len(ids)
            for found in encode(tool, batch.column("text").to_pylist(), kind):
                rest += [found, np.array([eod], kind)]
                held += len(found) + 1
                if held >= block_tokens:
                    rows += cut(False)
            yield batch_of(rows)
        yield batch_of(cut(True))

    schema = "file int, block long, payload binary, first long, doc_ids array<long>"
    return work.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(flat, schema), "flat")


def flat_blocks(spark: SparkSession, path: str, work: Work, eod: int = EOD, kind: str = "<u2", block_bytes: int = 2 * BLOCK_TOKENS) -> DataFrame:
    """file (its path), block (its first byte), payload of flat files under a path that Spark reads, of any size.

    The files are read as lines that end at a byte of the separator, so no line is longer than a document, and Spark
    splits a large file over many tasks. A block begins wherever a split does; the bytes of an id that was cut in two
    go to the later block.
    """
    width = np.dtype(kind).itemsize
    mark = next((b for b in eod.to_bytes(width, "little") if 0 < b < 128), 0)
    lines = spark.read.option("lineSep", chr(mark)).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line")
    )

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, at, no = [], 0, None, 0

        def block() -> pd.DataFrame:
            return pd.DataFrame([(*at, no, b"".join(held))], columns=["file", "size", "start", "no", "payload"])

        for pdf in batches:
            for *now, line in pdf[["file", "size", "start", "line"]].itertuples(index=False):
                if at != now and held:
                    yield block()
                    held, size = [], 0
                no = 0 if at != now else no
                at = now
                held += [line, bytes([mark])]
                size += len(line) + 1
                if size >= block_bytes:
                    yield block()
                    held, size, no = [], 0, no + 1
        if held:
            yield block()

    pieces = work.save(lines.mapInPandas(gather, "file string, size long, start long, no long, payload binary"), "pieces")
    order = Window.partitionBy("file").orderBy("start", "no")
    tail = F.expr(f"substring(payload, -{width}, {width})")
    places = (
        pieces.select("file", "start", "no", F.length("payload").alias("n"), tail.alias("tail"))
        .withColumn("at", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
        .withColumn("before", F.concat(*[F.coalesce(F.lag("tail", k).over(order), F.unhex(F.lit(""))) for k in range(width, 0, -1)]))
        .withColumn("cut", F.pmod("at", F.lit(width)).cast("int"))
        .select("file", "start", "no", "at", F.when(F.col("cut") > 0, F.expr("substring(before, -cut, cut)")).otherwise(F.unhex(F.lit(""))).alias("carry"))
    )
    whole = pieces.join(places, ["file", "start", "no"]).select(
        "file", F.col("at").alias("block"), F.concat("carry", F.expr("substring(payload, 1, cast(least(length(payload), size - at) as int))")).alias("bytes")
    )
    return whole.select("file", "block", F.expr(f"substring(bytes, 1, length(bytes) - length(bytes) % {width})").alias("payload"))


def block_lengths(payload: bytes, eod: int, kind: str = "<u2") -> tuple[int, int, int, int, list]:
    """Of a block: tokens, separators, tokens before the first, tokens after the last, lengths between them."""
    tokens = np.frombuffer(payload, kind)
    at = np.flatnonzero(tokens == eod)
    if not len(at):
        return len(tokens), 0, len(tokens), len(tokens), []
    return len(tokens), len(at), int(at[0]), int(len(tokens) - at[-1] - 1), (np.diff(at) - 1).tolist()


def scan(blocks: DataFrame, eod: int = EOD, kind: str = "<u2") -> DataFrame:
    """file, ordinal, n_tokens, closed: the documents of flat files given as file, block, payload."""
    key = next(f.dataType.simpleString() for f in blocks.schema if f.name == "file")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, b, *block_lengths(p, eod, kind)) for f, b, p in zip(pdf["file"], pdf["block"], pdf["payload"], strict=True)]
            yield pd.DataFrame(rows, columns=["file", "block", "tokens", "marks", "head", "tail", "inner"])

    found = blocks.select("file", "block", "payload").mapInPandas(search, f"file {key}, block long, tokens long, marks long, head long, tail long, inner array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        found.withColumn("base", F.coalesce(F.sum("marks").over(before), F.lit(0)))
        .withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .withColumn("after_mark", F.when(F.col("marks") > 0, F.col("start") + F.col("tokens") - F.col("tail")))
        .withColumn("carry", F.col("start") - F.coalesce(F.max("after_mark").over(before), F.lit(0)))
        .withColumn("last", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
    )
    closed = stitched.where("marks > 0").select(
        "file", "base", F.posexplode(F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))).alias("pos", "n_tokens")
    ).select("file", (F.col("base") + F.col("pos")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    open_end = F.when(F.col("marks") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tokens"))
    rest = stitched.where("last").select("file", (F.col("base") + F.col("marks")).alias("ordinal"), open_end.alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest.where("n_tokens > 0"))


def token_counts(docs: DataFrame, work: Work, tokenizer: str = TOKENIZER, eod: int = EOD) -> DataFrame:
    """doc_id, n_tokens of every row of docs, by way of flat files."""
    flat = write_flat(docs, work, tokenizer, eod)
    manifest = flat.where("payload IS NULL").select("file", "first", F.posexplode("doc_ids").alias("pos", "doc_id"))
    order = manifest.select("file", (F.col("first") + F.col("pos")).alias("ordinal"), "doc_id")
    return order.join(scan(flat.where("payload IS NOT NULL"), eod, id_kind(tokenizer, eod)), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), Work(spark))
