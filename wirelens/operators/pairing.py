"""Joins of two halves of one thing: requests and responses, syscall enters and exits, handshakes, stream headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT


def pair_http(m: DataFrame, ttl_ns: int = DEFAULT.pair_ttl_ns, client_only: bool = False) -> DataFrame:
    """Requests with their responses, per connection.

    m: seq, tgid, fd, ts_ns, dir (R or W), ret, is_request, is_response. Whatever follows a request on its
    connection either answers it or ends its wait, so a response's request is the row right before it. One
    shuffle on (tgid, fd).
    """
    w = Window.partitionBy("tgid", "fd").orderBy("ts_ns", "seq")
    own = F.col("is_request") & (F.col("ret") >= 0)
    if client_only:
        own = own & (F.col("dir") == "W")
    before = F.lag(F.struct(own.alias("ok"), "dir", "ts_ns", "seq", "method", "path")).over(w)
    back = (F.col("p.dir") == "W") & (F.col("dir") == "R")
    forth = (F.col("p.dir") == "R") & (F.col("dir") == "W")
    turned = back if client_only else back | forth
    return (
        m.where(F.col("dir").isin("R", "W"))
        .withColumn("p", before)
        .where(F.col("p.ok") & F.col("is_response") & (F.col("ret") >= 0) & turned & (F.col("ts_ns") - F.col("p.ts_ns") <= ttl_ns))
        .select(
            "tgid",
            "fd",
            F.col("p.seq").alias("request_seq"),
            F.col("seq").alias("response_seq"),
            F.col("p.method").alias("method"),
            F.col("p.path").alias("path"),
            "status",
            F.col("p.ts_ns").alias("t_start_ns"),
            F.col("ts_ns").alias("t_end_ns"),
            F.greatest(F.col("ts_ns") - F.col("p.ts_ns"), F.lit(0)).alias("latency_ns"),
            (F.col("p.dir") == "W").alias("is_client"),
        )
    )


def pair_streams(h: DataFrame) -> DataFrame:
    """Decoded HTTP/2 headers with their answers, per stream of a connection epoch.

    h: tgid, fd, epoch, stream_id, seq, ts_ns, method, path, status, reset. Trailers and requests without a path
    leave a waiting request alone; a status or a reset consumes it. outcome: exchange, or unpaired for a status
    without a request.
    """
    w = Window.partitionBy("tgid", "fd", "epoch", "stream_id").orderBy("ts_ns", "seq")
    request = F.col("status").isNull() & ~F.col("reset") & F.col("method").isNotNull() & (F.coalesce("path", F.lit("")) != "")
    steps = h.withColumn("request", request).where(F.col("request") | F.col("status").isNotNull() | F.col("reset"))
    before = F.lag(F.struct("request", "method", "path", "ts_ns", "seq")).over(w)
    paired = F.coalesce(F.col("p.request"), F.lit(False))
    return (
        steps.withColumn("p", before)
        .where(F.col("status").isNotNull())
        .select(
            "tgid",
            "fd",
            "epoch",
            "stream_id",
            F.when(paired, F.col("p.method")).alias("method"),
            F.when(paired, F.col("p.path")).alias("path"),
            "status",
            F.when(paired, F.greatest(F.col("ts_ns") - F.col("p.ts_ns"), F.lit(0))).alias("latency_ns"),
            F.when(paired, F.lit("exchange")).otherwise(F.lit("unpaired")).alias("outcome"),
        )
    )


def syscall_latency(calls: DataFrame) -> DataFrame:
    """Exits with the enter right before them, per thread and call family: calls(tid, family, seq, ts_ns, is_enter, ret)."""
    w = Window.partitionBy("tid", "family").orderBy("ts_ns", "seq")
    return (
        calls.withColumn("p", F.lag(F.struct("is_enter", "ts_ns")).over(w))
        .where(~F.col("is_enter") & F.col("p.is_enter"))
        .select("tid", "family", "seq", "ret", F.greatest(F.col("ts_ns") - F.col("p.ts_ns"), F.lit(0)).alias("latency_ns"))
    )


def handshake_latency(calls: DataFrame) -> DataFrame:
    """First enter to first successful exit (ret 1), over and over: calls(conn, seq, ts_ns, is_enter, ret)."""
    w = Window.partitionBy("conn").orderBy("ts_ns", "seq")
    done = (~F.col("is_enter") & (F.col("ret") == 1)).cast("int")
    run = F.coalesce(F.sum(done).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        calls.withColumn("run", run)
        .groupBy("conn", "run")
        .agg(
            F.min(F.when(F.col("is_enter"), F.col("ts_ns"))).alias("began"),
            F.max(F.when(done == 1, F.struct("ts_ns", "seq"))).alias("end"),
        )
        .where("began IS NOT NULL AND end IS NOT NULL AND end.ts_ns >= began")
        .select("conn", F.col("end.seq").alias("seq"), (F.col("end.ts_ns") - F.col("began")).alias("latency_ns"))
    )


def connection_fd(rows: DataFrame) -> DataFrame:
    """rows(conn, seq, ts_ns, fd, is_bind) with the fd that the connection was last bound to; null if never."""
    w = Window.partitionBy("conn").orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("bound_fd", F.last(F.when(F.col("is_bind"), F.col("fd")), True).over(w))


def unmapped_connections(rows: DataFrame) -> DataFrame:
    """Connections that were used before any fd was bound, once each."""
    return connection_fd(rows).where("NOT is_bind AND bound_fd IS NULL").select("conn").distinct()


def peer_as_of(calls: DataFrame, peers: DataFrame, ttl_ns: int = DEFAULT.peer_ttl_ns) -> DataFrame:
    """calls(tgid, fd, ts_ns, seq) with the peer of the latest row of peers(tgid, fd, ts_ns, peer) up to then, while fresh.

    A union and one window: sorted once on (tgid, fd, ts_ns), no range join.
    """
    rows = calls.select("tgid", "fd", "ts_ns", "seq", F.lit(None).cast("string").alias("peer"), F.lit(1).alias("side")).unionByName(
        peers.select("tgid", "fd", "ts_ns", F.lit(None).cast("long").alias("seq"), "peer", F.lit(0).alias("side"))
    )
    w = Window.partitionBy("tgid", "fd").orderBy("ts_ns", "side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("side") == 0, F.struct("ts_ns", "peer")), True).over(w)
    fresh = (F.col("ts_ns") - F.col("l.ts_ns") <= ttl_ns) & (F.col("fd") >= 0)
    return rows.withColumn("l", latest).where("side = 1").select("seq", "tgid", "fd", "ts_ns", F.when(fresh, F.col("l.peer")).alias("peer"))
