"""Views of the driver tables as wire telemetry: messages, socket latencies, side streams and dimensions.

Each event is half an exchange: view and click are requests, purchase, signup and error are responses; the user
is the process, the number in props the stream. Everything else follows from these by plain expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ns(ts):
    """Nanoseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone())) * 1000


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int")
    kind = F.col("event_type")
    request = kind.isin("view", "click")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("tgid"),
        F.lit(3).alias("fd"),
        epoch_ns(F.col("ts")).alias("ts_ns"),
        k.alias("k"),
        kind.alias("event_type"),
        F.when(request, F.lit("W")).otherwise(F.lit("R")).alias("dir"),
        F.when(kind == "view", F.lit("GET")).when(kind == "click", F.lit("POST")).alias("method"),
        F.when(kind == "purchase", F.lit(200)).when(kind == "signup", F.lit(404)).when(kind == "error", F.lit(500)).alias("status"),
        F.concat(F.lit("/users/"), F.col("user_id").cast("string"), F.lit("/items/"), k.cast("string")).alias("path"),
        F.floor(F.col("value") * 1e6).cast("long").alias("latency_ns"),
        F.concat(F.lit("svc"), (F.col("user_id") % 10).cast("string")).alias("src"),
        F.concat(F.lit("svc"), (k % 7).cast("string")).alias("dst"),
        F.lit(0).alias("ret"),
    )


#: The same view in DuckDB; every oracle over messages begins with it.
MESSAGES_SQL = r"""m AS (
  SELECT event_id AS seq, user_id AS tgid, 3 AS fd, epoch_us(ts) * 1000 AS ts_ns, k, event_type,
         CASE WHEN event_type IN ('view', 'click') THEN 'W' ELSE 'R' END AS dir,
         CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'POST' END AS method,
         CASE event_type WHEN 'purchase' THEN 200 WHEN 'signup' THEN 404 WHEN 'error' THEN 500 END AS status,
         '/users/' || user_id || '/items/' || k AS path, floor(value * 1e6)::BIGINT AS latency_ns,
         'svc' || (user_id % 10) AS src, 'svc' || (k % 7) AS dst, 0 AS ret
  FROM (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::INT AS k FROM events))"""


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response as a whole exchange of its own: GET with the response's status and latency."""
    m = messages(spark, sf_dir).where("status IS NOT NULL")
    grpc = F.col("k") % 5 == 0
    return m.select(
        "seq",
        "tgid",
        "fd",
        F.col("k").alias("stream_id"),
        F.lit("GET").alias("method"),
        "path",
        "status",
        F.when(grpc, F.lit("grpc")).otherwise(F.lit("http")).alias("protocol"),
        (F.col("ts_ns") - F.col("latency_ns")).alias("t_start_ns"),
        F.col("ts_ns").alias("t_end_ns"),
        "latency_ns",
        F.when(F.col("k") % 3 == 0, F.floor(F.col("latency_ns") * 9 / 10).cast("long")).alias("wire_ns"),
        "src",
        "dst",
    )


EXCHANGES_SQL = (
    MESSAGES_SQL
    + r""", x AS (
  SELECT seq, tgid, fd, k AS stream_id, 'GET' AS method, path, status, CASE WHEN k % 5 = 0 THEN 'grpc' ELSE 'http' END AS protocol,
         ts_ns - latency_ns AS t_start_ns, ts_ns AS t_end_ns, latency_ns,
         CASE WHEN k % 3 = 0 THEN floor(latency_ns * 9 / 10)::BIGINT END AS wire_ns, src, dst
  FROM m WHERE status IS NOT NULL)"""
)
