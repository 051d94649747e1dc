"""The registered queries: an operator over a view of the driver's tables, and the same in plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .config import DEFAULT, SECOND
from .functions import scalars as S
from .operators import aggregates as A
from .operators import crosscheck, enrich, export, filters, genai, pairing, policy, promql, reassembly, sampling, wire
from .plans.messages import EXCHANGES_SQL, MESSAGES_SQL, epoch_ns, exchanges, messages, table

DAY = 86_400 * SECOND
WEEK = 7 * DAY
HDR = "(CASE WHEN greatest({v}, 1) < 2048 THEN greatest({v}, 1) ELSE greatest({v}, 1) - greatest({v}, 1) % (1::BIGINT << (length(bin(greatest({v}, 1))) - 11)) + (1::BIGINT << (length(bin(greatest({v}, 1))) - 11)) - 1 END)"
M, X = f"WITH {MESSAGES_SQL}", f"WITH {EXCHANGES_SQL}"
ROUTE = "array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN ':id' ELSE s END), '/')"
CLASS = "CASE WHEN status BETWEEN 200 AND 599 THEN (status // 100) || 'xx' ELSE 'other' END"
PROTO = "CASE WHEN protocol = 'http' THEN 'http/1.1' ELSE protocol END"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _q(column: str, q: float, name: str) -> str:
    return f"quantile_disc({HDR.format(v=column)}, {q})::BIGINT AS {name}"


# --- statistics -------------------------------------------------------------------------------------------------


@query(
    f"""{X}, r AS (SELECT *, {ROUTE} AS route FROM x WHERE t_end_ns >= (SELECT max(t_end_ns) FROM x) - {WEEK})
SELECT method, route AS path, protocol, count(*) AS n, count(*) / {WEEK / SECOND} AS rate, {_q("latency_ns", 0.5, "p50_ns")}, {_q("latency_ns", 0.95, "p95_ns")},
  {_q("latency_ns", 0.99, "p99_ns")}, quantile_disc(CASE WHEN wire_ns IS NOT NULL THEN {HDR.format(v="wire_ns")} END, 0.5)::BIGINT AS wire_p50_ns,
  100.0 * count(*) FILTER (status BETWEEN 400 AND 499) / count(*) AS pct_4xx, 100.0 * count(*) FILTER (status BETWEEN 500 AND 599) / count(*) AS pct_5xx,
  CASE WHEN protocol = 'http' THEN method || ' ' || route ELSE protocol || ' ' || method || ' ' || route END AS label
FROM r GROUP BY method, route, protocol"""
)
def http_endpoint_stats(spark, sf):
    return A.http_endpoints(exchanges(spark, sf), WEEK)


def _sockets(spark, sf):
    m = messages(spark, sf)
    address = F.concat(F.lit("10.0."), (F.col("tgid") % 16).cast("string"), F.lit(".1:443 connect"))
    return m.select("seq", address.alias("label"), "ts_ns", F.when(F.col("event_type") == "error", -111).otherwise(0).alias("ret"), "latency_ns")


@query(
    f"""{M}, s AS (SELECT *, '10.0.' || (tgid % 16) || '.1:443 connect' AS label FROM m WHERE ts_ns >= (SELECT max(ts_ns) FROM m) - {WEEK})
SELECT label, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, {_q("latency_ns", 0.5, "p50_ns")}, {_q("latency_ns", 0.95, "p95_ns")}, {_q("latency_ns", 0.99, "p99_ns")}
FROM s GROUP BY label"""
)
def tcp_endpoint_stats(spark, sf):
    return A.tcp_endpoints(_sockets(spark, sf), WEEK)


@query(f"{M} SELECT seq, tgid, ts_ns, count(*) OVER (PARTITION BY tgid ORDER BY ts_ns RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS n_window FROM m")
def http_rolling_window(spark, sf):
    return A.rolling_count(messages(spark, sf), DAY, "tgid")


@query(f"{M} SELECT ts_ns - ts_ns % {3600 * SECOND} AS tick_ns, count(*) AS n FROM m GROUP BY 1")
def rate_ticks(spark, sf):
    return A.tick_counts(messages(spark, sf), 3600 * SECOND)


@query(
    f"""{X}, r AS (SELECT * FROM x WHERE t_end_ns >= (SELECT max(t_end_ns) FROM x) - {WEEK})
SELECT src, dst, count(*) AS n, count(*) / {WEEK / SECOND} AS rate, {_q("latency_ns", 0.5, "p50_ns")}, {_q("latency_ns", 0.99, "p99_ns")},
  100.0 * count(*) FILTER (status >= 500) / count(*) AS pct_5xx FROM r GROUP BY src, dst"""
)
def service_edges(spark, sf):
    return A.service_edges(exchanges(spark, sf), WEEK)


@query(f"{X} SELECT src, dst, count(*) AS cum_count, count(*) FILTER (status >= 500) AS cum_errors, sum(latency_ns)::BIGINT AS latency_sum_ns FROM x GROUP BY src, dst")
def edges_cumulative(spark, sf):
    return A.edges_cumulative(exchanges(spark, sf))


@query(
    f"""{X}, f AS (SELECT src, dst, min(seq) AS first FROM x GROUP BY src, dst), o AS (SELECT src, dst, row_number() OVER (ORDER BY first, src, dst) <= 20 AS own FROM f)
SELECT CASE WHEN own THEN x.src ELSE '_other' END AS src, CASE WHEN own THEN x.dst ELSE 'unknown' END AS dst, count(*) AS n, count(*) FILTER (NOT own) AS n_overflow
FROM x JOIN o ON x.src = o.src AND x.dst = o.dst GROUP BY 1, 2"""
)
def edge_overflow_cap(spark, sf):
    capped = A.capped_keys(exchanges(spark, sf), ["src", "dst"], 20, other={"dst": "unknown"})
    return capped.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.count_if("overflow").alias("n_overflow"))


def _buckets_sql(value: str) -> str:
    parts, low = [], None
    for b in DEFAULT.latency_bounds_ms:
        parts.append(f"count(*) FILTER ({value} / 1e6 <= {b}" + (f" AND {value} / 1e6 > {low})" if low is not None else ")"))
        low = b
    return "[" + ", ".join([*parts, f"count(*) FILTER ({value} / 1e6 > {low})"]) + "]"


def _series_sql(value: str) -> str:
    return f"""SELECT src, dst, method, {ROUTE} AS route, {CLASS} AS status_class, {PROTO} AS protocol, count(*) AS n, sum({value})::BIGINT AS sum_ns,
  {_buckets_sql(value)} AS buckets, count(*) FILTER (status >= 500) AS errors FROM x WHERE {value} IS NOT NULL GROUP BY ALL"""


@query(f"{X} {_series_sql('latency_ns')}")
def series_histogram(spark, sf):
    return A.series_histogram(exchanges(spark, sf))


@query(f"{X} {_series_sql('wire_ns')}")
def wire_histogram(spark, sf):
    return A.series_histogram(exchanges(spark, sf), value="wire_ns")


@query(
    f"""{X}, k AS (SELECT *, {ROUTE} AS route, {CLASS} AS class, {PROTO} AS proto FROM x),
f AS (SELECT src, dst, method, route, class, proto, min(seq) AS first FROM k GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY first, src, dst, method, route, class, proto) <= 50 AS own FROM f)
SELECT CASE WHEN own THEN src ELSE '_other' END AS src, CASE WHEN own THEN dst ELSE '_other' END AS dst, CASE WHEN own THEN class ELSE '_other' END AS status_class, count(*) AS n
FROM k JOIN o USING (src, dst, method, route, class, proto) GROUP BY ALL"""
)
def series_overflow_cap(spark, sf):
    return A.series_histogram(exchanges(spark, sf), cap=50).groupBy("src", "dst", "status_class").agg(F.sum("n").alias("n"))


@query(f"{M}, h AS (SELECT latency_ns FROM m WHERE event_type = 'signup' AND latency_ns > 0) SELECT count(*) AS n, sum(latency_ns)::BIGINT AS sum_ns, {_buckets_sql('latency_ns')} AS buckets FROM h")
def handshake_histogram(spark, sf):
    return A.handshake_histogram(messages(spark, sf).where("event_type = 'signup'"))


@query(f"{X}, r AS (SELECT *, CASE WHEN protocol = 'http' THEN method || ' ' || {ROUTE} ELSE protocol || ' ' || method || ' ' || {ROUTE} END AS label FROM x) SELECT label, status, count(*) AS n, list_sort(list(latency_ns))[count(*) // 2 + 1] AS p50_ns FROM r GROUP BY label, status")
def replay_report(spark, sf):
    return A.replay_report(exchanges(spark, sf))


@query(f"{X}, r AS (SELECT method || ' ' || path AS label, count(*) AS n FROM x GROUP BY 1) SELECT * FROM r ORDER BY n DESC, label LIMIT 32")
def topk_endpoints(spark, sf):
    return A.top(exchanges(spark, sf).groupBy(F.concat_ws(" ", "method", "path").alias("label")).agg(F.count(F.lit(1)).alias("n")), 32, "label")


@query(f"{M} SELECT event_type, count(*) AS n FROM m GROUP BY event_type")
def event_counters(spark, sf):
    return A.outcome_counts(messages(spark, sf), "event_type")


@query(f"{M}, t AS (SELECT tgid, ts_ns - ts_ns % {DAY} AS tick, count(*) AS total FROM m GROUP BY 1, 2) SELECT tgid, tick, greatest(total - coalesce(lag(total) OVER (PARTITION BY tgid ORDER BY tick), 0), 0) AS delta FROM t")
def counter_delta(spark, sf):
    t = messages(spark, sf).groupBy("tgid", (F.col("ts_ns") - F.pmod("ts_ns", F.lit(DAY))).alias("tick")).agg(F.count(F.lit(1)).alias("total"))
    return A.counter_deltas(t, "total", "tgid", "tick").select("tgid", "tick", "delta")


@query(f"{X} SELECT count(DISTINCT tgid) AS unmapped FROM x WHERE status >= 500")
def distinct_unmapped(spark, sf):
    return exchanges(spark, sf).where("status >= 500").agg(F.countDistinct("tgid").alias("unmapped"))


# --- scalars and filters ----------------------------------------------------------------------------------------


@query(f"{X} SELECT {CLASS} AS status_class, CASE WHEN (protocol = 'grpc' AND status <> 0) OR (protocol <> 'grpc' AND status >= 500) THEN 2 ELSE 0 END AS otel, count(*) AS n FROM x GROUP BY 1, 2")
def status_class_mix(spark, sf):
    return exchanges(spark, sf).groupBy(S.status_class(F.col("status")).alias("status_class"), S.span_otel_status(F.col("protocol"), F.col("status")).alias("otel")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{M} SELECT DISTINCT path, {ROUTE} AS route FROM m")
def normalize_paths(spark, sf):
    return messages(spark, sf).select("path", S.normalize_path(F.col("path")).alias("route")).distinct()


@query("SELECT page_id, split_part(url, '?', 1) AS bare, url LIKE '%?%' AS had_query FROM pages")
def strip_query(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.strip_query(F.col("url")).alias("bare"), F.col("url").contains("?").alias("had_query"))


@query(f"""{M}, r AS (SELECT seq, CASE WHEN k % 3 = 0 THEN 'post' ELSE 'GET' END AS method, CASE k % 4 WHEN 0 THEN '/v1/traces/' WHEN 1 THEN '/v1/logs' ELSE path END AS path FROM m)
SELECT seq, method, path FROM r WHERE NOT (upper(method) = 'POST' AND rtrim(path, '/') IN ('/v1/traces', '/v1/metrics', '/v1/logs'))""")
def otlp_route_filter(spark, sf):
    k = F.col("k")
    r = messages(spark, sf).select(
        "seq", F.when(k % 3 == 0, "post").otherwise("GET").alias("method"), F.when(k % 4 == 0, "/v1/traces/").when(k % 4 == 1, "/v1/logs").otherwise(F.col("path")).alias("path")
    )
    return r.where(~S.is_otlp_export_route(F.col("method"), F.col("path")))


def _with_comm(spark, sf):
    names = F.array(*map(F.lit, (DEFAULT.self_comm, "kubelet", "nginx", "otelcol", "python3")))
    return messages(spark, sf).select("seq", "tgid", F.col("tgid").alias("pid"), F.element_at(names, (F.col("tgid") % 5 + 1).cast("int")).alias("comm"))


COMM = f"{M}, c AS (SELECT seq, tgid, tgid AS pid, ['{DEFAULT.self_comm}', 'kubelet', 'nginx', 'otelcol', 'python3'][tgid % 5 + 1] AS comm FROM m)"


@query(f"{COMM} SELECT comm, count(*) AS n FROM c WHERE comm IN ('nginx', 'python3') GROUP BY comm")
def comm_filter_allow(spark, sf):
    return A.outcome_counts(_with_comm(spark, sf).where(filters.comm_allowed(F.col("comm"), allow=filters.parse_comm_list(f"nginx, python3, {DEFAULT.self_comm},"))), "comm")


@query(f"{COMM} SELECT comm, count(*) AS n FROM c WHERE comm NOT IN ('{DEFAULT.self_comm}', 'nginx', 'kubelet', 'otelcol') GROUP BY comm")
def comm_filter_deny(spark, sf):
    return A.outcome_counts(_with_comm(spark, sf).where(filters.comm_allowed(F.col("comm"), deny=["nginx"], k8s=True)), "comm")


@query(f"{COMM} SELECT CASE WHEN tgid IN (7, 9) OR comm = '{DEFAULT.self_comm}' THEN 'self_process' WHEN comm IN ('kubelet', 'otelcol') THEN 'denied' ELSE 'keep' END AS ingest, count(*) AS n FROM c GROUP BY 1")
def ingest_class(spark, sf):
    c = _with_comm(spark, sf)
    return A.outcome_counts(c.withColumn("ingest", filters.ingest_class(F.col("tgid"), F.col("pid"), F.col("comm"), [7, 9], k8s=True)), "ingest")


@query(f"{M} SELECT tgid, count(*) AS n FROM m WHERE tgid NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY tgid")
def capture_gate(spark, sf):
    denied = table(spark, sf, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("tgid"))
    return filters.capture_gate(messages(spark, sf), denied, allow=False).groupBy("tgid").agg(F.count(F.lit(1)).alias("n"))


#: splitmix64 on unsigned 128-bit numbers.
SPLITMIX = """
  z0 AS (SELECT *, ((x + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT) AS z FROM seed),
  z1 AS (SELECT * EXCLUDE z, ((xor(z, z >> 30) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT) AS z FROM z0),
  z2 AS (SELECT * EXCLUDE z, ((xor(z, z >> 27) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT) AS z FROM z1),
  h AS (SELECT * EXCLUDE z, xor(z, z >> 31) AS h FROM z2)"""


def _mix_sql(rows: str) -> str:
    return f"seed AS (SELECT *, xor(xor(xor(t_start_ns::UHUGEINT, tgid::UHUGEINT << 32), fd::UHUGEINT), stream_id::UHUGEINT << 17) AS x FROM {rows}),{SPLITMIX}"


@query(f"{M}, c AS (SELECT seq, tgid, fd, 0 AS stream_id, 0 AS t_start_ns FROM m), {_mix_sql('c')} SELECT seq, tgid FROM h WHERE h % 4 = 0")
def sticky_sample(spark, sf):
    return filters.sticky_sample(messages(spark, sf), 4).select("seq", "tgid")


@query(f"{X}, {_mix_sql('x')} SELECT seq, tgid FROM h WHERE h % 10 = 0")
def span_sample(spark, sf):
    return filters.span_sample(exchanges(spark, sf)).select("seq", "tgid")


@query(f"{X}, seed AS (SELECT seq, xor(xor(t_start_ns::UHUGEINT, tgid::UHUGEINT << 32), fd::UHUGEINT) AS x FROM x),{SPLITMIX} SELECT seq, lpad(lower(hex(h::UBIGINT)), 16, '0') AS trace_high FROM h")
def span_ids(spark, sf):
    return export.with_span_ids(exchanges(spark, sf)).select("seq", F.substring("trace_id", 1, 16).alias("trace_high"))


@query(
    f"""{M}, r AS (SELECT seq, tgid::VARCHAR || 'k' || k AS v FROM m)
SELECT seq, 'GET /u HTTP/1.1' || chr(13) || chr(10) || 'X-Api-Key: ' || repeat('*', length(v)) || chr(13) || chr(10) || 'cookie:  ' || repeat('*', 2 + length(v)) || chr(13) || chr(10)
   || 'Accept: ' || v || chr(13) || chr(10) || 'Proxy-AUTHORIZATION: ' || repeat('*', 7 + length(v)) || chr(13) || chr(10) || chr(13) || chr(10) AS text FROM r"""
)
def redact_headers(spark, sf):
    v = F.concat(F.col("tgid").cast("string"), F.lit("k"), F.col("k").cast("string"))
    text = F.concat(F.lit("GET /u HTTP/1.1\r\nX-Api-Key: "), v, F.lit("\r\ncookie:  c="), v, F.lit("\r\nAccept: "), v, F.lit("\r\nProxy-AUTHORIZATION: Bearer "), v, F.lit("\r\n\r\n"))
    return messages(spark, sf).select("seq", S.redact_headers(text).alias("text"))


@query("SELECT 'd' || doc_id AS item, CASE WHEN n_chars >= 1000000 THEN round(n_chars::DECIMAL(20, 6) / 1000000, 2)::DECIMAL(20, 2) || 'ms' WHEN n_chars >= 1000 THEN round(n_chars::DECIMAL(20, 6) / 1000, 1)::DECIMAL(20, 1) || 'µs' ELSE n_chars || 'ns' END AS shown, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '…' ELSE text END AS symbol FROM documents")
def formatted_values(spark, sf):
    return table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("item"), S.fmt_ns(F.col("n_chars")).alias("shown"), S.truncate_symbol(F.col("text")).alias("symbol"))


# --- joins ------------------------------------------------------------------------------------------------------


def _pairing_sql(where: str = "", ttl: int = DAY, client: bool = False) -> str:
    back = "(pd = 'W' AND dir = 'R')" if client else "((pd = 'W' AND dir = 'R') OR (pd = 'R' AND dir = 'W'))"
    own = " AND dir = 'W'" if client else ""
    return f"""{M}, v AS (SELECT *, method IS NOT NULL AND k % 9 <> 0 AS is_request, status IS NOT NULL OR k % 9 = 0 AS is_response, coalesce(status, 200) AS code, CASE WHEN k % 7 = 0 THEN CASE dir WHEN 'W' THEN 'R' ELSE 'W' END ELSE dir END AS d2 FROM m),
v2 AS (SELECT * REPLACE (d2 AS dir) FROM v),
p AS (SELECT *, lag(is_request AND ret >= 0{own}) OVER w AS ok, lag(dir) OVER w AS pd, lag(ts_ns) OVER w AS pt, lag(seq) OVER w AS ps, lag(method) OVER w AS pm, lag(path) OVER w AS pp FROM v2 WINDOW w AS (PARTITION BY tgid, fd ORDER BY ts_ns, seq))
SELECT tgid, fd, ps AS request_seq, seq AS response_seq, pm AS method, pp AS path, code AS status, pt AS t_start_ns, ts_ns AS t_end_ns, greatest(ts_ns - pt, 0) AS latency_ns, pd = 'W' AS is_client
FROM p WHERE ok AND is_response AND ret >= 0 AND {back} AND ts_ns - pt <= {ttl}"""


def _halves(spark, sf):
    m, k = messages(spark, sf), F.col("k")
    odd = F.when(F.col("dir") == "W", "R").otherwise("W")
    return (
        m.withColumn("is_request", F.col("method").isNotNull() & (k % 9 != 0))
        .withColumn("is_response", F.col("status").isNotNull() | (k % 9 == 0))
        .withColumn("status", F.coalesce("status", F.lit(200)))
        .withColumn("dir", F.when(k % 7 == 0, odd).otherwise(F.col("dir")))
    )


@query(_pairing_sql())
def http_pairing(spark, sf):
    return pairing.pair_http(_halves(spark, sf), DAY)


@query(_pairing_sql(client=True))
def pairing_client_only(spark, sf):
    return pairing.pair_http(_halves(spark, sf), DAY, client_only=True)


@query(_pairing_sql(ttl=3600 * SECOND))
def pairing_ttl(spark, sf):
    return pairing.pair_http(_halves(spark, sf), 3600 * SECOND)


@query(
    f"""{M}, s AS (SELECT tgid, k, ts_ns, seq, method, path, status, event_type = 'error' AS reset FROM m),
u AS (SELECT *, method IS NOT NULL AND NOT reset AND path <> '' AND CASE WHEN reset THEN NULL ELSE status END IS NULL AS request, CASE WHEN NOT reset THEN status END AS code FROM s),
p AS (SELECT *, lag(request) OVER w AS pr, lag(method) OVER w AS pm, lag(path) OVER w AS pp, lag(ts_ns) OVER w AS pt FROM u WHERE request OR code IS NOT NULL OR reset WINDOW w AS (PARTITION BY tgid, k ORDER BY ts_ns, seq))
SELECT tgid, 3 AS fd, 0 AS epoch, k AS stream_id, CASE WHEN pr THEN pm END AS method, CASE WHEN pr THEN pp END AS path, code AS status, CASE WHEN pr THEN greatest(ts_ns - pt, 0) END AS latency_ns,
  CASE WHEN pr THEN 'exchange' ELSE 'unpaired' END AS outcome FROM p WHERE code IS NOT NULL"""
)
def h2_stream_pairing(spark, sf):
    reset = F.col("event_type") == "error"
    h = messages(spark, sf).select("tgid", "fd", F.lit(0).alias("epoch"), F.col("k").alias("stream_id"), "seq", "ts_ns", "method", "path", F.when(~reset, F.col("status")).alias("status"), reset.alias("reset"))
    return pairing.pair_streams(h)


@query(
    f"""{M}, c AS (SELECT tgid AS tid, k % 3 AS family, seq, ts_ns, method IS NOT NULL AS enter, ret FROM m),
p AS (SELECT *, lag(enter) OVER w AS pe, lag(ts_ns) OVER w AS pt FROM c WINDOW w AS (PARTITION BY tid, family ORDER BY ts_ns, seq))
SELECT tid, family, seq, ret, greatest(ts_ns - pt, 0) AS latency_ns FROM p WHERE NOT enter AND pe"""
)
def syscall_latency(spark, sf):
    m = messages(spark, sf)
    return pairing.syscall_latency(m.select(F.col("tgid").alias("tid"), (F.col("k") % 3).alias("family"), "seq", "ts_ns", F.col("method").isNotNull().alias("is_enter"), "ret"))


@query(
    f"""{M}, c AS (SELECT tgid AS conn, seq, ts_ns, method IS NOT NULL AS enter, (event_type = 'purchase')::INT AS done FROM m),
g AS (SELECT *, coalesce(sum(done) OVER (PARTITION BY conn ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM c),
a AS (SELECT conn, run, min(ts_ns) FILTER (enter) AS began, max(ts_ns) FILTER (done = 1) AS ended, max(seq) FILTER (done = 1) AS seq FROM g GROUP BY conn, run)
SELECT conn, seq, ended - began AS latency_ns FROM a WHERE began IS NOT NULL AND ended IS NOT NULL AND ended >= began"""
)
def handshake_latency(spark, sf):
    m = messages(spark, sf)
    return pairing.handshake_latency(m.select(F.col("tgid").alias("conn"), "seq", "ts_ns", F.col("method").isNotNull().alias("is_enter"), (F.col("event_type") == "purchase").cast("int").alias("ret")))


@query(f"{M}, b AS (SELECT tgid AS conn, seq, ts_ns, k AS fd, event_type = 'signup' AS is_bind FROM m) SELECT conn, seq, last_value(CASE WHEN is_bind THEN fd END IGNORE NULLS) OVER (PARTITION BY conn ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS bound_fd FROM b")
def connection_fd(spark, sf):
    m = messages(spark, sf).select(F.col("tgid").alias("conn"), "seq", "ts_ns", F.col("k").alias("fd"), (F.col("event_type") == "signup").alias("is_bind"))
    return pairing.connection_fd(m).select("conn", "seq", "bound_fd")


@query(
    f"""{M}, q AS (SELECT seq, tgid, ts_ns FROM m WHERE method IS NOT NULL), s AS (SELECT tgid, ts_ns, max(dst) AS peer FROM m WHERE event_type = 'signup' GROUP BY ALL)
SELECT q.seq, q.tgid, 3 AS fd, q.ts_ns, CASE WHEN q.ts_ns - s.ts_ns <= {DAY} THEN s.peer END AS peer FROM q ASOF LEFT JOIN s ON q.tgid = s.tgid AND q.ts_ns >= s.ts_ns"""
)
def peer_asof(spark, sf):
    m = messages(spark, sf)
    return pairing.peer_as_of(m.where("method IS NOT NULL"), m.where("event_type = 'signup'").select("tgid", "fd", "ts_ns", F.col("dst").alias("peer")), DAY)


def _planes(spark, sf):
    x = exchanges(spark, sf)
    spans = x.select(F.col("seq").alias("xid"), "tgid", "fd", F.col("t_start_ns").alias("t0"), F.col("t_end_ns").alias("t1"), F.lit("W").alias("start_dir"), F.lit("R").alias("end_dir"))
    at = F.explode(
        F.array(
            F.struct((F.col("t_start_ns") - F.col("stream_id") * 100_000).alias("ts_ns"), F.lit("W").alias("dir")),
            F.struct((F.col("t_end_ns") + (F.col("stream_id") % 5 - 2) * 2_000_000).alias("ts_ns"), F.lit("R").alias("dir")),
        )
    )
    return spans, x.select("tgid", "fd", at.alias("a")).select("tgid", "fd", "a.ts_ns", "a.dir")


_PLANES = f"""{X}, t AS (SELECT tgid, fd, t_start_ns - stream_id * 100000 AS ts, 'W' AS d FROM x UNION ALL SELECT tgid, fd, t_end_ns + (stream_id % 5 - 2) * 2000000, 'R' FROM x),
b AS (SELECT x.seq AS xid, any_value(x.t_start_ns) AS t0, any_value(x.t_end_ns) AS t1, x.tgid, x.fd,
   max(ts) FILTER (d = 'W' AND ts BETWEEN t_start_ns - {DEFAULT.join_window_ns} AND t_start_ns) AS s, max(ts) FILTER (d = 'R' AND ts BETWEEN t_end_ns - {DEFAULT.join_window_ns} AND t_end_ns) AS e,
   max(ts) FILTER (d = 'R' AND ts BETWEEN t_end_ns + 1 AND t_end_ns + {DEFAULT.join_window_ns}) AS f FROM x LEFT JOIN t ON x.tgid = t.tgid AND x.fd = t.fd GROUP BY x.seq, x.tgid, x.fd),
o AS (SELECT *, coalesce(e - s > 0 AND e - s <= greatest(t1 - t0, 0) + {DEFAULT.wire_slack_ns}, false) AS hit, coalesce(f - s > 0 AND f - s <= greatest(t1 - t0, 0) + {DEFAULT.wire_slack_ns}, false) AS late FROM b),
j AS (SELECT xid, tgid, fd, t0, t1, 'W' AS start_dir, 'R' AS end_dir, CASE WHEN hit THEN e - s WHEN late THEN f - s END AS wire_ns, CASE WHEN hit THEN 'hit' WHEN late THEN 'fallback' ELSE 'miss' END AS outcome FROM o)"""


@query(f"{_PLANES} SELECT * FROM j")
def dual_plane_join(spark, sf):
    return wire.dual_plane(*_planes(spark, sf))


@query(f"{_PLANES} SELECT count(*) AS attempts, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'fallback') AS fallbacks, count(*) FILTER (outcome = 'miss') AS misses, coalesce(count(*) FILTER (outcome = 'hit') / nullif(count(*), 0)::DOUBLE, 0.0) AS hit_rate FROM j")
def join_outcomes(spark, sf):
    return wire.join_outcomes(wire.dual_plane(*_planes(spark, sf)))


@query(
    f"""{X}, s AS (SELECT seq, tgid, t_start_ns, t_end_ns FROM x), hs AS (SELECT seq AS id, tgid, ts_ns, latency_ns FROM m WHERE event_type = 'view'),
a AS (SELECT s.*, hs.id, hs.ts_ns AS ht, hs.latency_ns AS hl FROM s ASOF LEFT JOIN hs ON s.tgid = hs.tgid AND s.t_end_ns >= hs.ts_ns),
o AS (SELECT *, coalesce(ht <= t_start_ns AND t_end_ns - ht <= {DAY}, false) AS ok FROM a)
SELECT seq, CASE WHEN ok AND row_number() OVER (PARTITION BY tgid, id, ok ORDER BY t_end_ns, seq) = 1 THEN hl END AS handshake_ns FROM o"""
)
def handshake_asof_once(spark, sf):
    hs = messages(spark, sf).where("event_type = 'view'").select(F.col("seq").alias("hs_id"), "tgid", "fd", "ts_ns", "latency_ns")
    return wire.handshake_once(exchanges(spark, sf).select("seq", "tgid", "fd", "t_start_ns", "t_end_ns"), hs, DAY)


@query(
    f"""{X}, sp AS (SELECT seq AS span, tgid, t_end_ns - {DAY} AS t0, t_end_ns AS t1 FROM x), st AS (SELECT tgid, ts_ns, unnest(['f' || (k % 11), 'g' || (k % 4), 'main']) AS frame FROM m),
c AS (SELECT span, frame, count(*) AS n FROM sp JOIN st ON sp.tgid = st.tgid AND ts_ns BETWEEN t0 AND t1 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY span ORDER BY n DESC, frame) AS rank FROM c)
SELECT span, rank, frame, n FROM r WHERE rank <= 5"""
)
def profile_top_frames(spark, sf):
    spans = exchanges(spark, sf).select(F.col("seq").alias("span"), "tgid", (F.col("t_end_ns") - DAY).alias("t0"), F.col("t_end_ns").alias("t1"))
    k = F.col("k")
    stacks = messages(spark, sf).select("tgid", "ts_ns", F.array(F.concat(F.lit("f"), (k % 11).cast("string")), F.concat(F.lit("g"), (k % 4).cast("string")), F.lit("main")).alias("frames"))
    return wire.top_frames(spans, stacks, ttl_ns=DAY)


@query(f"{M}, i AS (SELECT tgid, seq, unnest([k * 100, 0, k * 7919 + 1]) AS ip, unnest([0, 1, 2]) AS pos FROM m), y AS (SELECT tgid, p * 1000 AS lo, p * 1000 + 600 AS hi, 'sym' || p AS name FROM (SELECT DISTINCT tgid FROM m), (SELECT unnest(range(0, 10)) AS p)), n AS (SELECT i.tgid, seq, pos, coalesce(name, '0x' || lower(hex(ip))) AS frame FROM i LEFT JOIN y ON i.tgid = y.tgid AND ip >= lo AND ip < hi WHERE ip <> 0) SELECT tgid, seq, list(frame ORDER BY pos) AS frames FROM n GROUP BY tgid, seq")
def symbolized_stacks(spark, sf):
    m = messages(spark, sf)
    k = F.col("k").cast("long")
    stacks = m.select("tgid", "seq", F.array(k * 100, F.lit(0).cast("long"), k * 7919 + 1).alias("ips"))
    p = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))
    symbols = m.select("tgid").distinct().select("tgid", p.alias("p")).select("tgid", (F.col("p") * 1000).alias("lo"), (F.col("p") * 1000 + 600).alias("hi"), F.concat(F.lit("sym"), F.col("p").cast("string")).alias("name"))
    return wire.symbolized(stacks, symbols)


def _addresses(spark, sf):
    k, t = F.col("k"), F.col("tgid")
    ip = F.when(k % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("10.1."), (t % 20).cast("string"), F.lit("."), (k % 10).cast("string")))
    return messages(spark, sf).select("seq", ip.alias("ip"), F.lit(8080).alias("port"))


@query(
    f"""{M}, a AS (SELECT seq, CASE WHEN k % 4 <> 0 THEN '10.1.' || (tgid % 20) || '.' || (k % 10) END AS ip, 8080 AS port FROM m),
p AS (SELECT '10.1.' || (s_suppkey % 20) || '.' || (s_suppkey % 10) AS ip, min(s_name) AS name FROM supplier GROUP BY 1), s AS (SELECT '10.1.' || (n_nationkey % 20) || '.' || (n_nationkey % 7) AS ip, min(n_name) AS name FROM nation GROUP BY 1)
SELECT seq, a.ip, port, coalesce('pods/' || p.name, 'svc/' || s.name, a.ip || ':' || port, 'unknown') AS dst FROM a LEFT JOIN p ON a.ip = p.ip LEFT JOIN s ON a.ip = s.ip"""
)
def dst_enrichment(spark, sf):
    at = lambda key, n: F.concat(F.lit("10.1."), (F.col(key) % 20).cast("string"), F.lit("."), (F.col(key) % n).cast("string")).alias("ip")
    pods = table(spark, sf, "supplier").groupBy(at("s_suppkey", 10)).agg(F.min("s_name").alias("name")).withColumn("namespace", F.lit("pods"))
    services = table(spark, sf, "nation").groupBy(at("n_nationkey", 7)).agg(F.min("n_name").alias("name")).withColumn("namespace", F.lit("svc"))
    return enrich.with_dst(_addresses(spark, sf), pods, services)


_UID = "'abcdef00-0000-4000-8000-' || lpad({0}::VARCHAR, 12, '0')"


@query(
    f"""{M}, x AS (SELECT seq, tgid, k AS cgroup_id FROM m), p AS (SELECT c_custkey AS tgid, c_mktsegment AS comm, CASE c_custkey % 3 WHEN 0 THEN c_custkey END AS u, CASE WHEN c_custkey % 3 = 1 THEN lpad(c_custkey::VARCHAR, 64, 'a') END AS cid FROM customer),
g AS (SELECT n_nationkey AS cgroup_id, n_nationkey AS u FROM nation), n AS (SELECT s_suppkey AS u, 'prod/' || s_name AS pod FROM supplier),
j AS (SELECT x.*, comm, cid, coalesce(p.u, g.u) AS u FROM x LEFT JOIN p ON x.tgid = p.tgid LEFT JOIN g ON x.cgroup_id = g.cgroup_id)
SELECT seq, j.tgid, j.cgroup_id, coalesce(pod, CASE WHEN j.u IS NOT NULL THEN 'pod:abcdef00' END, 'ctr:' || substr(cid, 1, 12), 'proc:' || coalesce(nullif(trim(comm), ''), 'unknown') || ':' || j.tgid) AS src FROM j LEFT JOIN n ON j.u = n.u"""
)
def src_enrichment(spark, sf):
    uid = lambda c, sep="-": F.concat(F.lit(f"abcdef00{sep}0000{sep}4000{sep}8000{sep}"), F.lpad(F.col(c).cast("string"), 12, "0"))
    c = F.col("c_custkey")
    path = F.when(c % 3 == 0, F.concat(F.lit("/kubepods.slice/kubepods-burstable-pod"), uid("c_custkey", "_"), F.lit(".slice"))).when(
        c % 3 == 1, F.concat(F.lit("/docker/"), F.lpad(c.cast("string"), 64, "a"))
    )
    procs = table(spark, sf, "customer").select(c.alias("tgid"), F.col("c_mktsegment").alias("comm"), F.coalesce(path, F.lit("/user.slice")).alias("cgroup"))
    cgroups = table(spark, sf, "nation").select(F.col("n_nationkey").alias("inode"), uid("n_nationkey").alias("pod_uid"))
    pods = table(spark, sf, "supplier").select(uid("s_suppkey").alias("uid"), F.lit("prod").alias("namespace"), F.col("s_name").alias("name"))
    x = messages(spark, sf).select("seq", "tgid", F.col("k").alias("cgroup_id"))
    return enrich.with_src(x, procs, cgroups, pods).select("seq", "tgid", "cgroup_id", "src")


RULES = "# folders\ndeny_open /users/1\ndeny_open /users/2/items/\n\ndeny_exec nc\ndeny_open /users/2\ndeny_exec 7\n"


@query(
    f"""{M}, o AS (SELECT seq, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AS op, path FROM m),
r AS (SELECT * FROM (VALUES (0, 1, '/users/1', 'deny_open /users/1'), (1, 1, '/users/2/items', 'deny_open /users/2/items'), (2, 2, 'nc', 'deny_exec nc'), (3, 1, '/users/2', 'deny_open /users/2'), (4, 2, '7', 'deny_exec 7')) t(no, op, v, rule)),
j AS (SELECT seq, o.op, path, rule, row_number() OVER (PARTITION BY seq ORDER BY no) AS turn FROM o JOIN r ON o.op = r.op AND CASE WHEN o.op = 1 THEN path = v OR starts_with(path, v || '/') ELSE string_split(path, '/')[-1] = v END)
SELECT seq, op, path, rule FROM j WHERE turn = 1"""
)
def policy_violations(spark, sf):
    ops = messages(spark, sf).select("seq", F.when(F.col("k") % 2 == 0, 1).otherwise(2).alias("op"), "path")
    return policy.violations(ops, policy.rule_table(spark, RULES))


@query("SELECT o_orderkey, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) AS closed FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def still_open(spark, sf):
    state = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("tgid"), F.lit(0).alias("fd"))
    live = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("tgid"), F.lit(0).alias("fd"))
    return filters.still_open(state, live).select("o_orderkey", F.lit(False).alias("closed"))


# --- model calls ------------------------------------------------------------------------------------------------


def _chat(spark, sf):
    turn, words = F.col("turn"), F.length("text")
    start = F.col("role").isin("system", "user")
    text = F.concat(
        F.when(turn % 2 == 1, F.concat(F.lit('{"type":"message_delta","usage":{"output_tokens": '), words.cast("string"), F.lit("}}"))).otherwise(F.concat(F.lit('{"usage":{"prompt_tokens":'), words.cast("string"), F.lit("}}"))),
        F.when(turn % 3 == 0, F.lit(" [DONE]")).otherwise(F.lit("")),
    )
    seq = F.col("turn")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("tgid"), F.lit(3).alias("fd"), seq.alias("seq"), (seq * SECOND).alias("ts_ns"), F.when(start & (turn % 4 == 0), "W").otherwise("R").alias("dir"), text.alias("text"),
        (start & (turn % 4 != 0)).alias("is_start"), (seq * SECOND - 1000).alias("t_start_ns"), F.lit("/v1/messages").alias("path"), F.lit(200).alias("status"),
    )


@query(
    r"""WITH c AS (SELECT conv_id AS tgid, turn AS seq, turn * 1000000000 AS ts, role IN ('system', 'user') AND turn % 4 = 0 AS w, role IN ('system', 'user') AND turn % 4 <> 0 AS st, length(text) AS v, turn FROM conversations),
d AS (SELECT *, NOT w AND NOT st AND turn % 3 = 0 AS stop FROM c),
p AS (SELECT *, sum(w::INT) OVER o + coalesce(sum(stop::INT) OVER (PARTITION BY tgid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM d WINDOW o AS (PARTITION BY tgid ORDER BY seq ROWS UNBOUNDED PRECEDING)),
i AS (SELECT *, max(st::INT) OVER (PARTITION BY tgid, part ORDER BY seq ROWS UNBOUNDED PRECEDING) AS begun FROM p),
h AS (SELECT *, row_number() OVER (PARTITION BY tgid, part ORDER BY seq) = 1 AS head FROM i WHERE begun = 1)
SELECT tgid, 3 AS fd, min(seq) FILTER (head) AS seq, '/v1/messages' AS path, 200 AS status, min(ts) FILTER (head) - 1000 AS start_ns, 1000 AS ttfb_ns, max(ts) - (min(ts) FILTER (head) - 1000) AS total_ns,
  arg_max(v, seq) FILTER (NOT head AND turn % 2 = 0) AS input_tokens, arg_max(v, seq) FILTER (NOT head AND turn % 2 = 1) AS output_tokens, bool_or(stop) AS complete, 'anthropic' AS provider
FROM h GROUP BY tgid, part"""
)
def llm_calls(spark, sf):
    return genai.llm_calls(_chat(spark, sf))


# --- streams, queues, snapshots ------------------------------------------------------------------------------------


@query(
    f"""{M}, q AS (SELECT seq, src AS node, ts_ns, row_number() OVER (PARTITION BY src, ts_ns // {DAY} ORDER BY ts_ns, seq) <= 20 AS kept FROM m) SELECT node, kept, count(*) AS n FROM q GROUP BY node, kept"""
)
def span_queue_cap(spark, sf):
    spans = messages(spark, sf).select("seq", F.col("src").alias("node"), "ts_ns")
    return sampling.span_queue(spans, DAY, 20).groupBy("node", "kept").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH RECURSIVE {MESSAGES_SQL}, t AS (SELECT src AS node, ts_ns // {3600 * SECOND} AS tick, count(*) FILTER (event_type = 'error' AND k % 10 = 0) AS drops FROM m GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY tick) AS i FROM t),
r AS (SELECT node, i, tick, CASE WHEN drops > 0 THEN 2 ELSE 1 END AS n, CASE WHEN drops > 0 THEN 0 ELSE 1 END AS quiet FROM o WHERE i = 1
  UNION ALL SELECT o.node, o.i, o.tick, CASE WHEN drops > 0 THEN least(16, r.n * 2) WHEN quiet + 1 >= 30 THEN greatest(1, r.n // 2) ELSE r.n END, CASE WHEN drops > 0 OR quiet + 1 >= 30 THEN 0 ELSE quiet + 1 END
  FROM r JOIN o ON o.node = r.node AND o.i = r.i + 1)
SELECT node, tick, n::BIGINT AS n FROM r"""
)
def sample_controller(spark, sf):
    hours = messages(spark, sf).groupBy(F.col("src").alias("node"), F.floor(F.col("ts_ns") / (3600 * SECOND)).alias("tick"))
    return sampling.sample_controller(hours.agg(F.count_if((F.col("event_type") == "error") & (F.col("k") % 10 == 0)).alias("drops")))


def _ids(spark, sf, name, key):
    return table(spark, sf, name).select(F.col(key).cast("long").alias("id"))


@query("SELECT 'remove' AS op, id FROM (SELECT c_custkey AS id FROM customer EXCEPT ALL SELECT s_suppkey * 2 FROM supplier) UNION ALL SELECT 'insert', id FROM (SELECT s_suppkey * 2 AS id FROM supplier EXCEPT ALL SELECT c_custkey FROM customer)")
def snapshot_delta(spark, sf):
    after = table(spark, sf, "supplier").select((F.col("s_suppkey") * 2).alias("id"))
    return filters.snapshot_delta(_ids(spark, sf, "customer", "c_custkey"), after).select("op", "id")


@query(f"{M}, r AS (SELECT tgid AS uid, ts_ns AS page, dst AS name, row_number() OVER (PARTITION BY tgid ORDER BY ts_ns DESC) AS turn FROM m) SELECT uid, page, name FROM r WHERE turn = 1")
def page_merge(spark, sf):
    return filters.page_merge(messages(spark, sf).select(F.col("tgid").alias("uid"), F.col("ts_ns").alias("page"), F.col("dst").alias("name")), "uid", "page")


@query("SELECT c_custkey AS id FROM customer UNION SELECT s_suppkey FROM supplier")
def self_ids(spark, sf):
    return filters.self_ids(_ids(spark, sf, "customer", "c_custkey"), _ids(spark, sf, "supplier", "s_suppkey"))


# --- binary records -----------------------------------------------------------------------------------------------


def _io(spark, sf):
    text = F.concat(F.coalesce("method", F.lit("HTTP/1.1")), F.lit(" "), F.coalesce(F.col("status").cast("string"), F.col("path")), F.lit("\r\n\r\n"))
    return messages(spark, sf).select("seq", "tgid", F.col("tgid").alias("pid"), F.col("fd"), "dir", "ts_ns", F.col("k").cast("long").alias("cgroup_id"), "k", text.alias("text"))


_PARTS_SQL = f"""{M}, t AS (SELECT *, row_number() OVER (PARTITION BY tgid, fd, dir ORDER BY ts_ns, seq) AS i, coalesce(method, 'HTTP/1.1') || ' ' || coalesce(status::VARCHAR, path) || chr(13) || chr(10) || chr(13) || chr(10) AS text FROM m),
u AS (SELECT *, i * 100 * {SECOND}::BIGINT AS began, CASE k % 4 WHEN 0 THEN 61 ELSE 1 END * {SECOND}::BIGINT AS gap, CASE WHEN k % 5 = 0 THEN left(text, length(text) - 4) || chr(13) || chr(10) || 'x: ' || repeat('y', 9000) ELSE text END AS whole FROM t)"""


@query(
    f"""{_PARTS_SQL} SELECT tgid, 3 AS fd, dir, i * 2 + 1 AS seq, CASE WHEN method IS NULL THEN began + gap ELSE began END AS ts_ns, left(whole, 256) AS text, 3 AS kind, tgid AS pid, k::BIGINT AS cgroup_id
FROM u WHERE gap <= 60 * {SECOND}::BIGINT"""
)
def reassembly_split(spark, sf):
    """Requests and responses in two parts: some wait longer than the TTL, some never end and are cut at the cap."""
    w = Window.partitionBy("tgid", "fd", "dir").orderBy("ts_ns", "seq")
    m = _io(spark, sf).withColumn("i", F.row_number().over(w).cast("long")).withColumn("at", F.col("i") * 100 * SECOND)
    cut = F.expr("left(text, length(text) - 4)")
    whole = F.when(F.col("k") % 5 == 0, F.concat(cut, F.lit("\r\nx: "), F.repeat(F.lit("y"), F.lit(9000)))).otherwise(F.col("text"))
    gap = F.when(F.col("k") % 4 == 0, 61).otherwise(1).cast("long") * SECOND
    m = m.withColumn("text", whole).withColumn("gap", gap)
    halves = F.explode(F.array(F.struct(F.lit(0).alias("i"), F.substring("text", 1, 9).alias("part")), F.struct(F.lit(1).alias("i"), F.substring("text", 10, 10_000).alias("part"))))
    chunks = m.select("tgid", "fd", "dir", (F.col("i") * 2).alias("seq"), "at", "gap", "pid", "cgroup_id", halves.alias("h")).select(
        "tgid", "fd", "dir", F.expr("seq + h.i").alias("seq"), F.expr("at + h.i * gap").alias("ts_ns"), F.col("h.part").alias("text"), F.lit(3).alias("kind"), "pid", "cgroup_id"
    )
    return reassembly.reassemble(chunks)


# --- query layer --------------------------------------------------------------------------------------------------


def _points(spark, sf):
    """Cumulative requests per edge and hour."""
    h = exchanges(spark, sf).groupBy("src", "dst", (F.col("t_end_ns") - F.pmod("t_end_ns", F.lit(3600 * SECOND))).alias("ts_ns")).agg(F.count(F.lit(1)).alias("c"))
    return h.select("src", "dst", "ts_ns", F.sum("c").over(Window.partitionBy("src", "dst").orderBy("ts_ns")).cast("double").alias("value"))


def _at(points):
    newest = points.agg(F.max("ts_ns").alias("newest"))
    return points.crossJoin(F.broadcast(newest))  # one row


_POINTS = f"{X}, c AS (SELECT src, dst, t_end_ns - t_end_ns % {3600 * SECOND} AS ts, count(*) AS c FROM x GROUP BY 1, 2, 3), p AS (SELECT src, dst, ts, sum(c) OVER (PARTITION BY src, dst ORDER BY ts)::DOUBLE AS value FROM c)"
_INCREASE = f"""{_POINTS}, a AS (SELECT max(ts) AS at0 FROM p), i AS (SELECT p.*, at0, value - lag(value) OVER (PARTITION BY src, dst ORDER BY ts) AS d FROM p, a WHERE ts > at0 - {WEEK} AND ts <= at0),
g AS (SELECT src, dst, sum(coalesce(d, 0)) AS raw, count(*) AS n, min(ts) AS first, max(ts) AS last, arg_min(value, ts) AS v0, any_value(at0) AS at0 FROM i GROUP BY 1, 2 HAVING count(*) >= 2),
e AS (SELECT *, last - first AS span, (last - first) / (n - 1) AS gap, first - (at0 - {WEEK}) AS room0, at0 - last AS room1 FROM g),
s AS (SELECT *, least(CASE WHEN room0 < gap * 1.1 THEN room0 ELSE gap / 2 END, CASE WHEN raw > 0 AND v0 >= 0 THEN span * (v0 / raw) ELSE 'inf'::DOUBLE END) AS r0, CASE WHEN room1 < gap * 1.1 THEN room1 ELSE gap / 2 END AS r1 FROM e),
w AS (SELECT src, dst, raw * ((span + r0 + r1) / span) AS increase FROM s)"""


@query(f"{_INCREASE} SELECT src, dst, round(increase, 6) AS increase FROM w")
def promql_increase(spark, sf):
    p = _at(_points(spark, sf))
    return promql.increase(p, ["src", "dst"], F.col("newest"), WEEK).select("src", "dst", F.round("increase", 6).alias("increase"))


@query(f"{_INCREASE} SELECT src, round(sum(increase / {WEEK / SECOND}), 9) AS rate FROM w GROUP BY src")
def promql_rate(spark, sf):
    r = promql.rate(_at(_points(spark, sf)), ["src", "dst"], F.col("newest"), WEEK)
    return promql.summed(r, "rate", ["src"]).select("src", F.round("rate", 9).alias("rate"))


@query(f"{_POINTS} SELECT src, dst, arg_max(value, ts) AS value FROM p GROUP BY 1, 2")
def promql_latest(spark, sf):
    return promql.latest(_points(spark, sf), ["src", "dst"])


@query(
    f"""{X}, r AS (SELECT {ROUTE} AS route, latency_ns / 1e6 AS ms FROM x WHERE protocol <> 'grpc'), le AS (SELECT unnest([{", ".join(f"{b}.0" for b in DEFAULT.latency_bounds_ms)}, 'inf'::DOUBLE]) AS le),
b AS (SELECT route, le, count(*) FILTER (ms <= le)::DOUBLE AS value FROM r, le GROUP BY 1, 2),
w AS (SELECT *, coalesce(lag(le) OVER o, 0.0) AS low, coalesce(lag(value) OVER o, 0.0) AS below, max(value) OVER (PARTITION BY route) AS total FROM b WINDOW o AS (PARTITION BY route ORDER BY le)),
f AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY le) AS turn FROM w WHERE value >= total * 0.99)
SELECT route, round(CASE WHEN le = 'inf' THEN low ELSE low + (le - low) * (total * 0.99 - below) / (value - below) END, 6) AS quantile FROM f WHERE turn = 1"""
)
def promql_histogram_quantile(spark, sf):
    x = exchanges(spark, sf).where("protocol <> 'grpc'")
    per_route = x.groupBy(S.normalize_path(F.col("path")).alias("route")).agg(A.buckets("latency_ns").alias("buckets"))
    b = promql.cumulative_buckets(per_route, ["route"], DEFAULT.latency_bounds_ms)
    return promql.histogram_quantile(0.99, b, ["route"]).select("route", F.round("quantile", 6).alias("quantile"))


# --- cross-check ----------------------------------------------------------------------------------------------------


def _gateway(spark, sf):
    m = messages(spark, sf)
    rows = m.where("event_type = 'view'").select(F.col("seq").alias("row_id"), "tgid", (F.col("ts_ns") / 1e9).alias("ts"))
    spans = m.where("event_type = 'click'").select(F.col("seq").alias("span_id"), "tgid", (F.col("ts_ns") / 1e9).alias("end"), (F.col("latency_ns") / 1e6).alias("total"))
    return rows, spans


_CROSS = f"{M}, r AS (SELECT seq AS row_id, tgid, ts_ns / 1e9 AS ts FROM m WHERE event_type = 'view'), s AS (SELECT seq AS span_id, tgid, ts_ns / 1e9 AS e, latency_ns / 1e6 AS total FROM m WHERE event_type = 'click'), c AS (SELECT row_id, span_id FROM r JOIN s ON r.tgid = s.tgid AND abs(e - ts) <= 7200.0)"


@query(f"{_CROSS} SELECT * FROM c")
def crosscheck_candidates(spark, sf):
    return crosscheck.candidates(*_gateway(spark, sf), 7200.0, "tgid").select("row_id", "span_id")


@query(f"{_CROSS} SELECT row_id FROM r WHERE row_id NOT IN (SELECT row_id FROM c)")
def crosscheck_unmatched(spark, sf):
    rows, spans = _gateway(spark, sf)
    return crosscheck.unmatched(rows, crosscheck.candidates(rows, spans, 7200.0, "tgid"), "row_id").select("row_id")


@query(
    f"""{_CROSS.replace("WITH ", "WITH RECURSIVE ", 1)}, n AS (SELECT r.tgid, row_id, ts, list(span_id ORDER BY total DESC, abs(e - ts), span_id) AS near FROM r JOIN s ON r.tgid = s.tgid AND abs(e - ts) <= 7200.0 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY tgid ORDER BY ts, row_id) AS i FROM n),
g AS (SELECT tgid, i, row_id, near[1] AS span_id, [near[1]] AS used FROM o WHERE i = 1
  UNION ALL SELECT tgid, i, row_id, free[1], CASE WHEN len(free) > 0 THEN list_append(used, free[1]) ELSE used END
  FROM (SELECT o.tgid, o.i, o.row_id, g.used, list_filter(o.near, lambda x: NOT list_contains(g.used, x)) AS free FROM g JOIN o ON o.tgid = g.tgid AND o.i = g.i + 1))
SELECT row_id, span_id FROM g WHERE span_id IS NOT NULL"""
)
def crosscheck_greedy(spark, sf):
    rows, spans = _gateway(spark, sf)
    return crosscheck.greedy(crosscheck.candidates(rows, spans, 7200.0, "tgid"), "tgid", 7200.0)


@query(
    f"""{M}, e AS (SELECT value - 50.0 AS v FROM events), a AS (SELECT list_sort(list(abs(v))) AS s, count(*) AS n, quantile_cont(v, 0.5) AS med FROM e)
SELECT n, round(med, 6) AS signed_median, round(s[least(n - 1, floor(0.5 * n)::BIGINT) + 1], 6) AS p50, round(s[least(n - 1, floor(0.9 * n)::BIGINT) + 1], 6) AS p90, round(s[n], 6) AS max FROM a"""
)
def error_distribution(spark, sf):
    e = table(spark, sf, "events").select((F.col("value") - 50.0).alias("err"))
    d = crosscheck.error_distribution(e, "err")
    return d.select("n", *[F.round(c, 6).alias(c) for c in ("signed_median", "p50", "p90", "max")])


@query(f"{M}, p AS (SELECT CASE WHEN k % 6 <> 0 THEN k END AS seen, CASE WHEN k % 5 = 0 THEN k + 1 ELSE k END AS told FROM m) SELECT count(*) FILTER (seen IS NOT DISTINCT FROM told) AS exact, count(*) FILTER (seen IS NULL) AS none, count(*) FILTER (seen IS NOT NULL AND seen IS DISTINCT FROM told) AS wrong, count(*) AS n FROM p")
def token_agreement(spark, sf):
    k = F.col("k")
    p = messages(spark, sf).select(F.when(k % 6 != 0, k).alias("seen"), F.when(k % 5 == 0, k + 1).otherwise(k).alias("told"))
    return crosscheck.token_agreement(p, "seen", "told")


@query(f"{M}, a AS (SELECT tgid, latency_ns, row_number() OVER (PARTITION BY tgid ORDER BY ts_ns) AS k FROM m WHERE event_type = 'view'), b AS (SELECT tgid, latency_ns, row_number() OVER (PARTITION BY tgid ORDER BY ts_ns) AS k FROM m WHERE event_type = 'click') SELECT a.tgid, a.latency_ns AS true_ns, b.latency_ns AS seen_ns FROM a JOIN b USING (tgid, k)")
def truth_zip(spark, sf):
    m = messages(spark, sf).select("tgid", "ts_ns", "latency_ns", "event_type")
    side = lambda kind: m.where(F.col("event_type") == kind).drop("event_type")
    return crosscheck.zip_rows(side("view"), side("click"), "tgid", "ts_ns").select("tgid", F.col("latency_ns").alias("true_ns"), F.col("r.latency_ns").alias("seen_ns"))


@query(f"{M} SELECT round(max(abs((latency_ns + k) - latency_ns) / latency_ns::DOUBLE), 9) AS worst FROM m WHERE latency_ns > 0")
def worst_relative_error(spark, sf):
    p = messages(spark, sf).where("latency_ns > 0").select((F.col("latency_ns") + F.col("k")).alias("seen"), F.col("latency_ns").alias("told"))
    return crosscheck.worst_relative_error(p, "seen", "told").select(F.round("worst", 9).alias("worst"))


# --- gates, clocks, names -----------------------------------------------------------------------------------------


@query(
    f"""{M}, r AS (SELECT tgid, fd, seq, method IS NOT NULL AS magic, event_type = 'error' AS cleared FROM m),
s AS (SELECT *, coalesce(last_value(CASE WHEN cleared THEN false WHEN magic THEN true END IGNORE NULLS) OVER (PARTITION BY tgid, fd ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inflight FROM r)
SELECT tgid, seq FROM s WHERE (magic OR inflight) AND NOT cleared"""
)
def emit_gate(spark, sf):
    text = F.when(F.col("method").isNotNull(), F.concat("method", F.lit(" /"))).otherwise(F.lit("body"))
    rows = messages(spark, sf).select("tgid", "fd", "seq", text.alias("text"), (F.col("event_type") == "error").alias("cleared"))
    return filters.emit_gate(rows).select("tgid", "seq")


@query(f"{M}, t AS (SELECT DISTINCT tgid FROM m WHERE event_type = 'signup' AND k % 5 = 0) SELECT CASE WHEN tgid IN (SELECT tgid FROM t) THEN 'times' ELSE 'content' END AS stream, count(*) AS n FROM m WHERE tgid NOT IN (SELECT tgid FROM t) OR k - 20 > 0 GROUP BY 1")
def tls_split(spark, sf):
    m = messages(spark, sf).withColumn("ret", (F.col("k") - 20).cast("long"))
    content, times = filters.split_tls(m, m.where("event_type = 'signup' AND k % 5 = 0"))
    named = content.select(F.lit("content").alias("stream")).unionByName(times.select(F.lit("times").alias("stream")))
    return A.outcome_counts(named, "stream")


@query(f"{M}, b AS (SELECT tgid AS conn, seq, ts_ns, event_type = 'signup' AS is_bind FROM m), f AS (SELECT *, max(is_bind::INT) OVER (PARTITION BY conn ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS known FROM b) SELECT DISTINCT conn FROM f WHERE NOT is_bind AND known = 0")
def unmapped_connections(spark, sf):
    m = messages(spark, sf).select(F.col("tgid").alias("conn"), "seq", "ts_ns", F.col("k").alias("fd"), (F.col("event_type") == "signup").alias("is_bind"))
    return pairing.unmapped_connections(m)


@query(f"{M}, p AS (SELECT c_custkey AS tgid, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment ELSE '' END AS comm FROM customer) SELECT seq, m.tgid, coalesce(nullif(a.comm, ''), nullif(b.comm, ''), '') AS comm FROM m LEFT JOIN p a ON a.tgid = m.tgid LEFT JOIN p b ON b.tgid = k")
def comm_lookup(spark, sf):
    c = F.col("c_custkey")
    procs = table(spark, sf, "customer").select(c.alias("tgid"), F.when(c % 4 != 0, F.col("c_mktsegment")).otherwise("").alias("comm"))
    return enrich.comm_of(messages(spark, sf).select("seq", "tgid", F.col("k").cast("long").alias("pid")), procs).select("seq", "tgid", "comm")


@query("SELECT c_custkey AS pid, c_mktsegment AS comm FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def process_leaders(spark, sf):
    c = F.col("c_custkey")
    procs = table(spark, sf, "customer").select(c.alias("pid"), F.when(c % 2 == 0, c).otherwise(c - 1).alias("tgid"), F.when(c % 3 != 0, F.col("c_mktsegment")).otherwise("").alias("comm"))
    return enrich.leaders(procs).select("pid", "comm")


@query(f"{X} SELECT seq, greatest(t_end_ns - latency_ns, 0) AS start_ns, t_end_ns AS end_ns, t_end_ns - greatest({WEEK} + k2 - (latency_ns + k2), 0) AS call_end_ns FROM (SELECT *, stream_id AS k2 FROM x)")
def wall_clock(spark, sf):
    k = F.col("stream_id").cast("long")
    plain = S.unix_range(F.col("latency_ns"), F.col("t_end_ns"))
    call = S.unix_range_of_call(k, F.col("latency_ns"), k + WEEK, F.col("t_end_ns"))
    return exchanges(spark, sf).select("seq", plain.alias("p"), call.alias("c")).select("seq", "p.start_ns", "p.end_ns", F.col("c.end_ns").alias("call_end_ns"))


@query(f"{M}, v AS (SELECT src, list_sort(list(latency_ns)) AS s, count(*) AS n FROM m WHERE latency_ns > 0 GROUP BY src) SELECT src, s[round((n - 1) * 0.5)::INT + 1] AS p50_ns FROM v")
def handshake_p50(spark, sf):
    return messages(spark, sf).where("latency_ns > 0").groupBy("src").agg(A.sorted_index("latency_ns", "round", 0.5).alias("p50_ns"))


@query(f"{M} SELECT ts_ns - ts_ns % {3600 * SECOND} AS tick_ns, count(*) AS n FROM m GROUP BY 1 ORDER BY 1 DESC LIMIT 60")
def sparkline(spark, sf):
    return A.sparkline(messages(spark, sf), 60, 3600 * SECOND)


@query("SELECT * FROM (VALUES ('http.client.duration', 'http_client_duration_milliseconds_bucket'), ('http.client.requests', 'http_client_requests_total'), ('service.edges', 'service_edges')) t(name, shown)")
def exposition_names(spark, sf):
    rows = [("http.client.duration", "histogram", "ms"), ("http.client.requests", "sum", "1"), ("service.edges", "gauge", "1")]
    return spark.createDataFrame(rows, "name string, kind string, unit string").select("name", promql.exposition_name(F.col("name"), F.col("kind"), F.col("unit")).alias("shown"))


@query(f"{M}, b AS (SELECT seq, '/users/1/items/' || k AS path FROM m WHERE tgid = 1) SELECT count(*) AS detected, 0::BIGINT AS missing, 0::BIGINT AS unexpected FROM b")
def policy_gate(spark, sf):
    ops = messages(spark, sf).select("seq", F.lit(1).alias("op"), "path")
    found = policy.violations(ops, policy.rule_table(spark, "deny_open /users/1\n"))
    return policy.gate(found, messages(spark, sf).where("tgid = 1").select("seq"))


# --- documents ------------------------------------------------------------------------------------------------------


@query()
def otlp_metrics_json(spark, sf):
    return export.metrics_json(export.metric_points(A.series_histogram(exchanges(spark, sf)), 0, 1))


@query()
def otlp_traces_json(spark, sf):
    x = export.with_span_ids(exchanges(spark, sf))
    null = lambda kind: F.lit(None).cast(kind)
    spans = x.select(
        "seq", "trace_id", "span_id", S.endpoint_label(F.col("method"), F.col("path"), F.col("protocol")).alias("name"), F.lit(True).alias("kind_client"), F.col("t_start_ns").alias("start_unix_ns"),
        F.col("t_end_ns").alias("end_unix_ns"), "src", "dst", "method", F.col("path").alias("route"), S.protocol_attr(F.col("protocol")).alias("protocol"), "status", "wire_ns", null("long").alias("handshake_ns"),
        null("array<string>").alias("profile_frames"), null("struct<provider:string,input_tokens:bigint,output_tokens:bigint,ttfb_ns:bigint,complete:boolean>").alias("llm"),
    )
    return export.traces_json(spans)


__all__ = ["ORACLES", "QUERIES", "epoch_ns"]

from . import catalog_logs  # noqa: E402,F401  (registers its queries)
