"""Rolling and cumulative statistics of exchanges and sockets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, SECOND
from ..functions import scalars as S


def recent(df: DataFrame, window_ns: int, at: str = "ts_ns") -> DataFrame:
    """The rows of the last window_ns before the newest one, both ends included. The newest time is a one-row broadcast."""
    newest = df.agg(F.max(at).alias("__newest"))
    return df.join(F.broadcast(newest), F.col(at) >= F.col("__newest") - window_ns).drop("__newest")


def quantile(column: str, q: float) -> Column:
    """Nearest rank of values that are rounded to three digits first, so that a group holds a bounded number of them."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def _quantiles(column: str, prefix: str = "", qs: tuple[int, ...] = (50, 95, 99)) -> list[Column]:
    return [quantile(column, q / 100).cast("long").alias(f"{prefix}p{q}_ns") for q in qs]


def tcp_endpoints(sockets: DataFrame, window_ns: int = DEFAULT.window_ns) -> DataFrame:
    """Per (address, port, kind): count, errors, p50, p95, p99 over the last window. sockets: label, ts_ns, ret, latency_ns."""
    return (
        recent(sockets, window_ns)
        .withColumn("v", S.hdr_rounded(F.col("latency_ns")))
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(S.is_syscall_error(F.col("ret"))).alias("errors"), *_quantiles("v"))
    )


def http_endpoints(x: DataFrame, window_ns: int = DEFAULT.window_ns) -> DataFrame:
    """Per (method, path, protocol): count, rate, quantiles, wire median, shares of 4xx and 5xx (500 to 599)."""
    share = lambda low: 100.0 * F.count_if(F.col("status").between(low, low + 99)) / F.count(F.lit(1))
    return (
        recent(x.withColumn("path", S.normalize_path(S.strip_query(F.col("path")))), window_ns, "t_end_ns")
        .withColumn("v", S.hdr_rounded(F.col("latency_ns")))
        .withColumn("w", F.when(F.col("wire_ns").isNotNull(), S.hdr_rounded(F.col("wire_ns"))))
        .groupBy("method", "path", "protocol")
        .agg(
            F.count(F.lit(1)).alias("n"),
            (F.count(F.lit(1)) / (window_ns / SECOND)).alias("rate"),
            *_quantiles("v"),
            quantile("w", 0.5).cast("long").alias("wire_p50_ns"),
            share(400).alias("pct_4xx"),
            share(500).alias("pct_5xx"),
        )
        .withColumn("label", S.endpoint_label(F.col("method"), F.col("path"), F.col("protocol")))
    )


def service_edges(x: DataFrame, window_ns: int = DEFAULT.window_ns) -> DataFrame:
    """Per (src, dst) over the last window; here every status from 500 on is an error."""
    return (
        recent(x, window_ns, "t_end_ns")
        .withColumn("v", S.hdr_rounded(F.col("latency_ns")))
        .groupBy("src", "dst")
        .agg(
            F.count(F.lit(1)).alias("n"),
            (F.count(F.lit(1)) / (window_ns / SECOND)).alias("rate"),
            *_quantiles("v", qs=(50, 99)),
            (100.0 * F.count_if(F.col("status") >= 500) / F.count(F.lit(1))).alias("pct_5xx"),
        )
    )


def edges_cumulative(x: DataFrame) -> DataFrame:
    return x.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("cum_count"), F.count_if(F.col("status") >= 500).alias("cum_errors"), F.sum("latency_ns").alias("latency_sum_ns")
    )


def capped_keys(df: DataFrame, keys: list[str], cap: int, order: str = "seq", other: dict[str, str] | None = None) -> DataFrame:
    """df in which only the `cap` keys seen first keep their own names; later ones share the overflow key.

    Keys are reduced to one row each before they are ranked; the rank is a limit of at most cap rows, found without
    bringing all keys into one task, and those rows (bounded by the cap) are broadcast.
    """
    first = df.groupBy(*keys).agg(F.min(order).alias("__first")).orderBy("__first", *keys).limit(cap).select(*keys, F.lit(True).alias("__own"))
    marked = df.join(F.broadcast(first), keys, "left")
    kept = F.coalesce(F.col("__own"), F.lit(False))
    named = {k: F.when(kept, F.col(k)).otherwise(F.lit((other or {}).get(k, "_other"))) for k in keys}
    return marked.withColumns(named | {"overflow": ~kept}).drop("__own")


def buckets(column: str, bounds: tuple[int, ...] = DEFAULT.latency_bounds_ms) -> Column:
    """Counts per explicit bucket (value <= bound in ms; the last holds the rest), not cumulative."""
    ms = F.col(column) / 1e6
    counts, low = [], None
    for bound in bounds:
        inside = ms <= bound if low is None else (ms > low) & (ms <= bound)
        counts.append(F.count_if(inside))
        low = bound
    return F.array(*counts, F.count_if(ms > low))


def series_histogram(x: DataFrame, cap: int = DEFAULT.max_series, value: str = "latency_ns") -> DataFrame:
    """Cumulative series per (src, dst, method, route, status_class, protocol) with buckets, sum and errors (from 500)."""
    keys = ["src", "dst", "method", "route", "status_class", "protocol"]
    named = (
        x.where(F.col(value).isNotNull())
        .withColumn("route", S.normalize_path(S.strip_query(F.col("path"))))
        .withColumn("status_class", S.status_class(F.col("status")))
        .withColumn("protocol", S.protocol_attr(F.col("protocol")))
    )
    return (
        capped_keys(named, keys, cap)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum_ns"), buckets(value).alias("buckets"), F.count_if(F.col("status") >= 500).alias("errors"))
    )


def handshake_histogram(handshakes: DataFrame) -> DataFrame:
    return handshakes.where("latency_ns > 0").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ns").alias("sum_ns"), buckets("latency_ns").alias("buckets"))


def at_rank(column: str, index: Column) -> Column:
    """The value at a 0-based index of a group's sorted values."""
    return F.element_at(F.array_sort(F.collect_list(column)), (index + 1).cast("int"))


def sorted_index(column: str, rule: str, q: float = 0.5) -> Column:
    """The reference points of small reports: half (n div 2), round ((n - 1) q) or floor (min(n - 1, int(q n)))."""
    n = F.count(column)
    index = {"half": F.floor(n / 2), "round": F.round((n - 1) * q), "floor": F.least(n - 1, F.floor(n * q))}[rule]
    return at_rank(column, index)


def replay_report(x: DataFrame) -> DataFrame:
    """Per label and status: count and the middle value. Values are counted first, so a group holds distinct ones only."""
    named = x.withColumn("label", S.endpoint_label(F.col("method"), S.normalize_path(F.col("path")), F.col("protocol")))
    values = named.groupBy("label", "status", "latency_ns").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("label", "status")
    ranked = values.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy("latency_ns")))
    middle = F.floor(F.col("n") / 2)
    return ranked.where((F.col("upto") > middle) & (F.col("upto") - F.col("c") <= middle)).select("label", "status", "n", F.col("latency_ns").alias("p50_ns"))


def rolling_count(m: DataFrame, window_ns: int, key: str) -> DataFrame:
    """For every row: rows of its key in the last window, both ends included."""
    w = Window.partitionBy(key).orderBy("ts_ns").rangeBetween(-window_ns, 0)
    return m.select("seq", key, "ts_ns", F.count(F.lit(1)).over(w).alias("n_window"))


def tick_counts(m: DataFrame, tick_ns: int = SECOND) -> DataFrame:
    return m.groupBy((F.col("ts_ns") - F.pmod("ts_ns", F.lit(tick_ns))).alias("tick_ns")).agg(F.count(F.lit(1)).alias("n"))


def counter_deltas(ticks: DataFrame, value: str, key: str, order: str) -> DataFrame:
    """The saturating increase of a counter since the tick before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return ticks.withColumn("delta", F.greatest(F.col(value) - F.coalesce(before, F.lit(0)), F.lit(0)))


def outcome_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def top(df: DataFrame, n: int, *ties: str) -> DataFrame:
    """The n largest by count, ties by name (one bounded sort in each task, no total sort)."""
    return df.orderBy(F.desc("n"), *ties).limit(n)


def sparkline(m: DataFrame, ticks: int = 60, tick_ns: int = SECOND) -> DataFrame:
    """The newest ticks with events, with their counts."""
    return tick_counts(m, tick_ns).orderBy(F.desc("tick_ns")).limit(ticks)


def total_requests(series: DataFrame) -> DataFrame:
    return series.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def resource_use(samples: DataFrame) -> DataFrame:
    """Mean CPU and largest memory of samples(cpu, rss)."""
    return samples.agg(F.avg("cpu").alias("mean_cpu"), F.max("rss").alias("max_rss"))
