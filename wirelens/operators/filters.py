"""Predicates on records and set operations on snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT
from ..functions import scalars as S


def parse_comm_list(text: str | None) -> list[str]:
    return [name for name in (part.strip() for part in (text or "").split(",")) if name]


def comm_allowed(comm: Column, allow: list[str] = (), deny: list[str] = (), k8s: bool = False, self_comm: str = DEFAULT.self_comm) -> Column:
    """Own name never; with an allow list only its names; else all but the denied ones. An unknown name is an empty one."""
    comm = F.coalesce(comm, F.lit(""))
    denied = [*deny, *(DEFAULT.k8s_deny if k8s else ())]
    listed = comm.isin(*allow) if allow else ~comm.isin(*denied) if denied else F.lit(True)
    return (comm != self_comm) & listed


def ingest_class(tgid: Column, pid: Column, comm: Column, self_ids: list[int], **rules) -> Column:
    """self_process, denied or keep."""
    own = tgid.isin(*self_ids) | pid.isin(*self_ids) | F.coalesce(comm == rules.get("self_comm", DEFAULT.self_comm), F.lit(False))
    return F.when(own, F.lit("self_process")).when(~comm_allowed(comm, **rules), F.lit("denied")).otherwise(F.lit("keep"))


def capture_gate(rows: DataFrame, tgids: DataFrame, allow: bool) -> DataFrame:
    """Rows whose tgid is on an allow list, or not on a deny list."""
    return rows.join(tgids.select("tgid").distinct(), "tgid", "left_semi" if allow else "left_anti")


def emit_gate(rows: DataFrame) -> DataFrame:
    """Rows that start with HTTP magic, or follow such a row on their fd until it is cleared.

    rows: tgid, fd, seq, text, cleared. The flag is the latest of marks and clears before the row.
    """
    w = Window.partitionBy("tgid", "fd").orderBy("seq")
    magic = S.http_magic(F.col("text"))
    state = F.last(F.when(F.col("cleared"), F.lit(False)).when(magic, F.lit(True)), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("inflight", F.coalesce(state, F.lit(False))).where((magic | F.col("inflight")) & ~F.col("cleared")).drop("inflight")


def sticky_sample(rows: DataFrame, n: int, epoch: Column | None = None) -> DataFrame:
    """One connection in n, by a hash of its key: every row of a connection shares its fate."""
    h = S.mix64(F.col("tgid"), F.col("fd"), F.lit(0) if epoch is None else epoch, F.lit(0).cast("long"))
    return rows.where(S.unsigned_mod(h, max(n, 1)) == 0)


def span_sample(spans: DataFrame, n: int = DEFAULT.trace_sample) -> DataFrame:
    return spans.where(S.unsigned_mod(S.mix64(F.col("tgid"), F.col("fd"), F.col("stream_id"), F.col("t_start_ns")), max(n, 1)) == 0)


def streamed_llm(x: DataFrame, paths: tuple[str, ...] = DEFAULT.llm_paths) -> DataFrame:
    """Exchanges that begin a model's streamed answer: x with request and response texts."""
    return x.where(S.strip_query(S.request_path(F.col("request"))).isin(*paths) & S.is_sse(F.col("response")))


def snapshot_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """op (remove or insert) and the rows that changed between two snapshots."""
    gone = before.exceptAll(after).withColumn("op", F.lit("remove"))
    return gone.unionByName(after.exceptAll(before).withColumn("op", F.lit("insert")))


def page_merge(pages: DataFrame, key: str, page: str) -> DataFrame:
    """Pages put together: for each key the row of the last page."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(page)))
    return pages.withColumn("__turn", newest).where("__turn = 1").drop("__turn")


def keep_last_snapshot(fresh: DataFrame, previous: DataFrame, failed: bool) -> DataFrame:
    """A refresh that failed keeps what was known."""
    return previous if failed else fresh


def still_open(state: DataFrame, live: DataFrame) -> DataFrame:
    """State whose connection is in one of the live tables."""
    return state.join(live.select("tgid", "fd").distinct(), ["tgid", "fd"], "left_semi")


def self_ids(*sources: DataFrame) -> DataFrame:
    """The distinct ids of several sources."""
    out = sources[0]
    for s in sources[1:]:
        out = out.union(s)
    return out.distinct()


def split_tls(io: DataFrame, tls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(content, times): rows on a TLS connection keep only when they happened, and only if bytes moved; others keep all.

    io: tgid, fd, ret, ...; tls: tgid, fd of TLS connections.
    """
    marked = io.join(tls.select("tgid", "fd").distinct().withColumn("__tls", F.lit(True)), ["tgid", "fd"], "left")
    times = marked.where("__tls AND ret > 0").select("seq", "tgid", "fd", "dir", "ret", "ts_ns")
    return marked.where("__tls IS NULL").drop("__tls"), times


def active(snapshot: DataFrame, cumulative: bool = False) -> DataFrame:
    """Rows of a snapshot that have counted something."""
    return snapshot.where("n > 0 OR cum_count > 0" if cumulative else "n > 0")
