"""Streamed model calls: from the exchange whose answer is an event stream to the stream's end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S


def llm_calls(rows: DataFrame) -> DataFrame:
    """One row a call. rows: tgid, fd, seq, ts_ns, dir, text, is_start (the answer's headers), t_start_ns, path, status.

    A call takes in the reads after its start until one holds a stop marker (complete), the connection's next
    write, or the end of the rows. Tokens are the last that were reported; none stays null. A start while a call
    is running belongs to that call.
    """
    key = ["tgid", "fd"]
    w = Window.partitionBy(*key).orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    stop = F.col("text").contains("message_stop") | F.col("text").contains("[DONE]")
    # A read with a stop marker closes what is open after it; a write closes what is open before it.
    marked = rows.withColumn("stop", F.coalesce(stop & (F.col("dir") == "R") & ~F.col("is_start"), F.lit(False))).withColumn(
        "part",
        F.sum((F.col("dir") == "W").cast("int")).over(upto) + F.coalesce(F.sum(F.col("stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    begun = F.max(F.col("is_start").cast("int")).over(Window.partitionBy(*key, "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    inside = marked.withColumn("begun", begun).where("begun = 1")
    head = F.row_number().over(Window.partitionBy(*key, "part").orderBy("seq")) == 1
    chunk = inside.withColumn("head", head)
    text = F.when(~F.col("head"), F.col("text"))
    tokens_in = F.coalesce(S.number_after(text, "input_tokens"), S.number_after(text, "prompt_tokens"))
    tokens_out = F.coalesce(F.when(text.contains("message_delta"), S.number_after(text, "output_tokens")), S.number_after(text, "completion_tokens"))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
    return (
        chunk.withColumn("tin", tokens_in)
        .withColumn("tout", tokens_out)
        .groupBy(*key, "part")
        .agg(
            F.min(F.when(F.col("head"), F.struct("seq", "t_start_ns", "path", "status", "ts_ns"))).alias("s"),
            F.max("ts_ns").alias("end_ns"),
            last(F.col("tin")).alias("input_tokens"),
            last(F.col("tout")).alias("output_tokens"),
            F.bool_or("stop").alias("complete"),
        )
        .select(
            *key,
            F.col("s.seq").alias("seq"),
            F.col("s.path").alias("path"),
            F.col("s.status").alias("status"),
            F.col("s.t_start_ns").alias("start_ns"),
            F.greatest(F.col("s.ts_ns") - F.col("s.t_start_ns"), F.lit(0)).alias("ttfb_ns"),
            F.greatest(F.col("end_ns") - F.col("s.t_start_ns"), F.lit(0)).alias("total_ns"),
            "input_tokens",
            "output_tokens",
            "complete",
            S.llm_provider(F.col("s.path")).alias("provider"),
        )
    )


def llm_line(calls: DataFrame) -> DataFrame:
    """The log line of each call."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return calls.select(
        F.concat_ws(
            " ",
            F.lit("llm_call"),
            F.concat(F.lit("path="), "path"),
            F.concat(F.lit("status="), F.col("status").cast("string")),
            F.concat(F.lit("ttfb="), S.fmt_ns(F.col("ttfb_ns"))),
            F.concat(F.lit("total="), S.fmt_ns(F.col("total_ns"))),
            F.concat(F.lit("in="), shown("input_tokens")),
            F.concat(F.lit("out="), shown("output_tokens")),
            F.concat(F.lit("complete="), F.col("complete").cast("string")),
        ).alias("line")
    )


def log_fields(lines: DataFrame) -> DataFrame:
    """The key=value fields of log lines, as a map."""
    pairs = F.regexp_extract_all("line", F.lit(r"(\w+=\S+)"), F.lit(1))
    return lines.select("line", F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)), F.substring_index(p, "=", -1)))).alias("fields"))
