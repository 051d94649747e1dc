"""Structured Streaming forms of the operators.

Every stream takes the schema of the batch tables. Windows need event time: `event_time` is made of ts_ns, with a
watermark. The router keeps a connection's state between batches with the same object as the batch plan.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, SECOND
from ..functions import scalars as S
from ..operators import aggregates, policy
from ..plans import replay

STATE = "state binary"


def timed(df: DataFrame, late: str = "60 seconds", column: str = "ts_ns") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_micros(F.floor(F.col(column) / 1000))).withWatermark("event_time", late)


def tick_rate(stream: DataFrame) -> DataFrame:
    """Events a second."""
    return timed(stream).groupBy(F.window("event_time", "1 second")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("tick"), "n")


def rolling_endpoints(x: DataFrame, every: str = "1 second", size: str = "60 seconds") -> DataFrame:
    """Endpoint statistics over sliding windows (half open, unlike the batch snapshot's)."""
    return (
        timed(x, column="t_end_ns")
        .withColumn("path", S.normalize_path(F.col("path")))
        .withColumn("v", S.hdr_rounded(F.col("latency_ns")))
        .groupBy(F.window("event_time", size, every), "method", "path", "protocol")
        .agg(F.count(F.lit(1)).alias("n"), aggregates.quantile("v", 0.5).cast("long").alias("p50_ns"), F.count_if(F.col("status").between(500, 599)).alias("n_5xx"))
    )


def edges(x: DataFrame) -> DataFrame:
    """Cumulative edges; run in complete or update mode."""
    return aggregates.edges_cumulative(x)


def idle_sessions(m: DataFrame, gap: str = "60 seconds") -> DataFrame:
    """Runs of a connection's events with no gap as long as this."""
    return (
        timed(m)
        .groupBy(F.session_window("event_time", gap), "tgid", "fd")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("tgid", "fd", F.col("session_window.start").alias("began"), F.col("session_window.end").alias("over"), "n")
    )


def policy_violations(ops: DataFrame, rules: DataFrame, write: Callable[[DataFrame], None]) -> DataStreamWriter:
    """A writer that gives the violations of each micro-batch to `write`: the batch plan, whose equi-joins scan no rule list."""
    return ops.writeStream.foreachBatch(lambda batch, _: write(policy.violations(batch, rules)))


def routed(io: DataFrame, ttl_ns: int = DEFAULT.pair_ttl_ns) -> DataFrame:
    """Exchanges and model calls of a stream of decoded I/O rows.

    State is one router a connection, kept as bytes. Rows of a batch are put in order first. A connection that is
    quiet for the TTL in event time is closed, and an open model stream is given as incomplete.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        router = pickle.loads(state.get[0]) if state.exists else replay.Router()
        if state.hasTimedOut:
            state.remove()
            yield replay.rows_frame(router.end(), *key)
            return
        rows, newest = [], 0
        pdf = pd.concat(list(batches))
        for r in pdf.sort_values("seq").itertuples():
            rows += router.feed(r.dir, int(r.ret), int(r.ts_ns), bytes(r.prefix), int(r.cgroup_id), r.kind == 4)
            newest = max(newest, int(r.ts_ns))
        state.update((pickle.dumps(router),))
        state.setTimeoutTimestamp(max(newest + ttl_ns, state.getCurrentWatermarkMs() * 1_000_000 + SECOND) // 1_000_000 + 1)
        yield replay.rows_frame(rows, *key)

    return timed(io.where("dir IS NOT NULL")).groupBy("tgid", "fd").applyInPandasWithState(run, replay.EXCHANGE, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, mode: str, checkpoint: str, table: str) -> DataFrame:
    """Runs a stream over what there is, into a memory table; for tests and one-off replays."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(table)


def files(spark: SparkSession, path: str, like: DataFrame, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


__all__ = ["drain", "edges", "files", "idle_sessions", "policy_violations", "rolling_endpoints", "routed", "tick_rate"]
