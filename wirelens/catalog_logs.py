"""Queries over a stored event log, HTTP/2 connections, message texts, reports and rates of bucket counters, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalog import DAY, M, ROUTE, WEEK, X, query
from .config import DEFAULT, SECOND
from .functions import scalars as S
from .operators import aggregates as A
from .operators import crosscheck, enrich, export, filters, genai, h2, promql
from .plans import replay
from .plans.messages import MESSAGES_SQL, exchanges, messages, table
from .sources import evlog

HOUR = 3600 * SECOND
#: The log's clock runs faster than the tables', so that halves fall within the pairing TTL.
CLOCK = 100_000

# --- the log --------------------------------------------------------------------------------------------------------

_logs: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; a temporary folder only in local sessions that name none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return tempfile.mkdtemp(prefix="wirelens-log-")


def _io_rows(spark, sf):
    text = F.concat(F.coalesce("method", F.lit("HTTP/1.1")), F.lit(" "), F.coalesce(F.col("status").cast("string"), F.col("path")), F.lit("\r\n\r\n"))
    m = messages(spark, sf).withColumn("text", text)
    return m.select(
        "seq", F.when(F.col("k") % 2 == 0, 4).otherwise(3).alias("kind"), "dir", "fd", F.col("tgid").alias("pid"), "tgid", F.length("text").cast("long").alias("ret"),
        F.expr(f"ts_ns div {CLOCK}").alias("ts_ns"), F.col("k").cast("long").alias("cgroup_id"), "text",
    )


def all_records(spark: SparkSession, sf: str) -> DataFrame:
    """at, tgid, seq, rec: records of all eight kinds made of the messages."""
    m, k = messages(spark, sf), F.col("k")
    pid = (F.col("tgid") + 1).alias("pid")
    error = F.when(F.col("event_type") == "error", -111).otherwise(0).alias("ret")
    socket = m.select("seq", (k % 2 + 1).alias("kind"), pid, "tgid", error, "latency_ns", "ts_ns", (k * 16777216 + 10).alias("daddr_be"), F.lit(0xBB01).alias("dport_be"))
    times = m.select("seq", F.lit(5).alias("kind"), "dir", (-k).alias("fd"), pid, "tgid", (k - 50).alias("ret"), "ts_ns")
    shakes = m.where("event_type = 'signup'").select("seq", F.lit(6).alias("kind"), pid, "tgid", k.alias("fd"), F.lit(1).alias("ret"), "latency_ns", "ts_ns")
    ips = F.transform(F.sequence(F.lit(1), k % 10 + 1), lambda i: i * 4096 + F.col("seq"))
    stacks = m.select("seq", F.lit(7).alias("kind"), "tgid", pid, "ts_ns", F.slice(ips, F.lit(1), (k % 10).cast("int")).alias("ips"))
    files = m.select("seq", F.lit(8).alias("kind"), (k % 3).alias("op"), pid, "tgid", "ts_ns", k.alias("cgroup_id"), "path")
    parts = [(_io_rows(spark, sf), evlog.IO), (socket, evlog.SOCKET), (times, evlog.TIMES), (shakes, evlog.HANDSHAKE), (stacks, evlog.STACK), (files, evlog.FILE_OP)]
    whole = None
    for rows, layout in parts:
        keyed = rows.withColumn("seq", F.struct(F.col("ts_ns").alias("at"), "tgid", "seq"))
        made = evlog.encode(keyed, layout).select("seq.at", "seq.tgid", "seq.seq", "rec")
        whole = made if whole is None else whole.unionByName(made)
    return whole


def stored_log(spark: SparkSession, sf: str) -> DataFrame:
    """The records of a log that is written once a session: each process in one file or in files that follow each other."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _logs:
        path = f"{shared_folder(spark)}/wirelens-log-{uuid.uuid4().hex}"
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        evlog.write_logs(all_records(spark, sf).repartition(parts, "tgid").sortWithinPartitions("at", "seq"), path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        _logs[key] = path
    return evlog.read_logs(spark, _logs[key])


_IO = rf"""t AS (SELECT *, ts_ns // {CLOCK} AS clock, coalesce(method, 'HTTP/1.1') || ' ' || coalesce(status::VARCHAR, path) || chr(13) || chr(10) || chr(13) || chr(10) AS text FROM m)"""


@query(f"{M}, {_IO} SELECT CASE WHEN k % 2 = 0 THEN 4 ELSE 3 END AS kind, dir, length(text)::INT AS prefix_len, fd, tgid AS pid, tgid, length(text) AS ret, clock AS ts_ns, k::BIGINT AS cgroup_id, text FROM t")
def decode_io(spark, sf):
    return evlog.decode_io(stored_log(spark, sf)).withColumn("text", S.latin1(F.col("prefix"))).drop("prefix", "file", "seq")


@query(f"{M}, {_IO} SELECT CASE WHEN k % 2 = 0 THEN 'tls_io' ELSE 'sock_io' END AS kind, count(*) AS n, sum(length(text))::BIGINT AS bytes FROM t GROUP BY 1")
def decode_kinds(spark, sf):
    d = evlog.decode_io(stored_log(spark, sf))
    return d.groupBy(S.coded(F.col("kind"), S.KINDS).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("prefix_len").alias("bytes"))


@query(
    f"""{M} SELECT (k % 2 + 1)::INT AS kind, tgid + 1 AS pid, tgid, CASE WHEN event_type = 'error' THEN -111 ELSE 0 END::BIGINT AS ret, latency_ns, ts_ns, '10.0.0.' || k || ':443 ' || CASE WHEN k % 2 = 0 THEN 'connect' ELSE 'accept' END AS label FROM m"""
)
def decode_socket(spark, sf):
    d = evlog.decode_socket(stored_log(spark, sf))
    return d.withColumn("label", S.tcp_endpoint(F.col("daddr_be"), F.col("dport_be"), F.col("kind"))).drop("file", "seq", "daddr_be", "dport_be")


@query(f"{M} SELECT dir, (-k)::INT AS fd, tgid + 1 AS pid, tgid, (k - 50)::BIGINT AS ret, ts_ns FROM m")
def decode_times(spark, sf):
    return evlog.decode_times(stored_log(spark, sf)).drop("file", "seq")


@query(f"{M} SELECT tgid + 1 AS pid, tgid, k::INT AS fd, 1::BIGINT AS ret, latency_ns, ts_ns FROM m WHERE event_type = 'signup'")
def decode_handshake(spark, sf):
    return evlog.decode_handshake(stored_log(spark, sf)).drop("file", "seq")


@query(f"{M} SELECT tgid, tgid + 1 AS pid, ts_ns, list_transform(range(1, k % 10 + 1), lambda i: i * 4096 + seq) AS ips FROM m WHERE k % 10 <= 8")
def decode_stacks(spark, sf):
    return evlog.decode_stacks(stored_log(spark, sf)).drop("file", "seq")


@query(f"{M} SELECT (k % 3)::INT AS op, tgid + 1 AS pid, tgid, ts_ns, k::BIGINT AS cgroup_id, path FROM m")
def decode_file_ops(spark, sf):
    return evlog.decode_file_ops(stored_log(spark, sf)).drop("file", "seq")


_REPLAY = f"""{M}, q AS (SELECT tgid, seq, ts_ns // {CLOCK} AS t, method, status, path FROM m),
p AS (SELECT *, lag(method) OVER w AS pm, lag(path) OVER w AS pp, lag(t) OVER w AS pt FROM q WINDOW w AS (PARTITION BY tgid ORDER BY t, seq)),
e AS (SELECT pm || ' ' || {ROUTE.replace("path", "pp")} AS label, status, t - pt AS d FROM p WHERE status IS NOT NULL AND pm IS NOT NULL AND t - pt <= {DEFAULT.pair_ttl_ns}),
r AS (SELECT label, status, count(*) AS n, list_sort(list(d))[count(*) // 2 + 1] AS p50_ns FROM e GROUP BY label, status)"""


@query(f"{_REPLAY} SELECT * FROM r")
def replay_log(spark, sf):
    """The whole replay of a stored log: scan, decode, route, pair, report."""
    return replay.report(stored_log(spark, sf))


@query(
    f"""{_REPLAY}, c AS (SELECT count(*) * 5 + count(*) FILTER (event_type = 'signup') AS n FROM m)
SELECT 0 AS part, 'records=' || n AS line FROM c UNION ALL SELECT 1, label || ' ' || status || ' count=' || n || ' p50_ns=' || p50_ns FROM r"""
)
def replay_lines(spark, sf):
    return replay.report_lines(stored_log(spark, sf))


# --- HTTP/2 -----------------------------------------------------------------------------------------------------------


def _h2_chunks(spark, sf):
    """HTTP/2 connections made of the messages: a preface, then a header frame for each half, by stream."""
    k = F.col("k")
    size = lambda n: F.concat(evlog.little_endian(F.lit(0), 2), evlog.little_endian(n, 1))
    stream = F.concat(evlog.little_endian(F.lit(0), 3), evlog.little_endian(k * 2 + 1, 1))
    path = F.encode("path", "ISO-8859-1")
    asked = F.concat(F.when(F.col("method") == "GET", F.unhex(F.lit("8204"))).otherwise(F.unhex(F.lit("8304"))), evlog.little_endian(F.length(path), 1), path)
    told = F.when(F.col("status") == 200, F.unhex(F.lit("88"))).when(F.col("status") == 404, F.unhex(F.lit("8d"))).otherwise(F.unhex(F.lit("8e")))
    block = F.when(F.col("method").isNotNull(), asked).otherwise(told)
    header = F.concat(size(F.length(block)), F.unhex(F.lit("0104")), stream, block)
    m = messages(spark, sf)
    at = F.expr("ts_ns div 1000000").alias("ts_ns")
    chunks = m.select("tgid", "fd", F.expr("ts_ns * 2 + 1").alias("order"), "seq", at, "dir", header.alias("prefix"), F.lit(False).alias("client_only"))
    opened = m.groupBy("tgid", "fd").agg(F.min("ts_ns").alias("ts_ns"))
    preface = F.encode(F.lit("PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"), "ISO-8859-1").alias("prefix")
    opened = opened.select("tgid", "fd", F.expr("ts_ns * 2").alias("order"), F.lit(0).cast("long").alias("seq"), at, F.lit("W").alias("dir"), preface, F.lit(False).alias("client_only"))
    rank = F.row_number().over(Window.partitionBy("tgid", "fd").orderBy("order", "seq")).cast("long")
    return chunks.unionByName(opened).withColumn("seq", rank).drop("order")


_H2 = f"""{M}, p AS (SELECT *, ts_ns // 1000000 AS t, lag(method) OVER w AS pm, lag(path) OVER w AS pp, lag(ts_ns // 1000000) OVER w AS pt FROM m WINDOW w AS (PARTITION BY tgid, k ORDER BY ts_ns, seq)),
e AS (SELECT tgid, 3 AS fd, (k * 2 + 1)::BIGINT AS stream_id, pm AS method, pp AS path, status, pt AS t_start_ns, t AS t_end_ns, t - pt AS latency_ns, 'h2' AS protocol, true AS is_client FROM p WHERE status IS NOT NULL AND pm IS NOT NULL)"""


@query(f"{_H2} SELECT * FROM e")
def h2_replay(spark, sf):
    return h2.h2_exchanges(_h2_chunks(spark, sf))


@query(
    f"""{_H2} SELECT 'conns' AS what, count(DISTINCT tgid) AS n FROM m UNION ALL SELECT 'exchanges', count(*) FROM e UNION ALL SELECT 'headers_req', count(*) FROM m WHERE method IS NOT NULL
UNION ALL SELECT 'headers_resp', count(*) FROM m WHERE status IS NOT NULL UNION ALL SELECT 'unpaired_status', (SELECT count(*) FROM m WHERE status IS NOT NULL) - (SELECT count(*) FROM e)
UNION ALL SELECT unnest(['dropped_streams', 'missing_path', 'desync']), 0"""
)
def h2_statistics(spark, sf):
    return h2.h2_statistics(_h2_chunks(spark, sf))


# --- message texts ------------------------------------------------------------------------------------------------------


def _texts(spark, sf):
    """Requests, responses and near misses."""
    k = F.col("k")
    start = F.element_at(F.array(*map(F.lit, ("GET ", "POST ", "PRI ", "HTTP/1.1 ", "POSTGRES ", "PRINTER ", "http/1.1 ", ""))), (k % 8 + 1).cast("int"))
    head = F.concat(start, F.when(k % 8 == 3, F.concat(F.coalesce(F.col("status"), F.lit(204)).cast("string"), F.lit(" OK"))).otherwise(F.col("path")), F.lit("\r\nHost: h\r\n"))
    kind = F.when(k % 3 == 0, F.lit("Content-Type: text/Event-Stream; x=1\r\n")).otherwise(F.lit(""))
    return messages(spark, sf).select("seq", "k", F.concat(head, kind, F.when(k % 5 != 0, F.lit("\r\n")).otherwise(F.lit(""))).alias("text"))


_TEXTS = f"""{M}, x AS (SELECT seq, k, ['GET ', 'POST ', 'PRI ', 'HTTP/1.1 ', 'POSTGRES ', 'PRINTER ', 'http/1.1 ', ''][k % 8 + 1] || CASE WHEN k % 8 = 3 THEN coalesce(status, 204)::VARCHAR || ' OK' ELSE path END
  || chr(13) || chr(10) || 'Host: h' || chr(13) || chr(10) || CASE WHEN k % 3 = 0 THEN 'Content-Type: text/Event-Stream; x=1' || chr(13) || chr(10) ELSE '' END || CASE WHEN k % 5 <> 0 THEN chr(13) || chr(10) ELSE '' END AS text, path, status FROM m)"""


@query(f"{_TEXTS} SELECT seq, k % 8 < 4 AS magic, k % 8 < 2 AS request, k % 8 = 3 AS response, k % 5 <> 0 AS done FROM x")
def http_magic(spark, sf):
    t = F.col("text")
    return _texts(spark, sf).select("seq", S.http_magic(t).alias("magic"), S.looks_like_request(t).alias("request"), S.looks_like_response(t).alias("response"), S.headers_done(t).alias("done"))


@query(
    f"""{_TEXTS} SELECT seq, CASE k % 8 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PRI' WHEN 4 THEN 'POSTGRES' WHEN 5 THEN 'PRINTER' END AS method,
  CASE WHEN k % 8 IN (0, 1, 2, 4, 5) THEN path END AS path, CASE WHEN k % 8 = 3 THEN coalesce(status, 204) END AS status, CASE WHEN k % 8 = 3 THEN coalesce(status, 204) ELSE 0 END AS lenient,
  CASE WHEN k % 3 = 0 THEN 'text/Event-Stream; x=1' END AS content_type, k % 3 = 0 AS sse FROM x"""
)
def message_fields(spark, sf):
    t = F.col("text")
    return _texts(spark, sf).select(
        "seq", S.request_method(t).alias("method"), S.request_path(t).alias("path"), S.response_status(t).alias("status"), S.status_code(t).alias("lenient"),
        S.header_value(t, "content-type").alias("content_type"), S.is_sse(t).alias("sse"),
    )


@query(f"{_TEXTS} SELECT seq FROM x WHERE k % 3 = 0 AND k % 4 < 3")
def streamed_llm(spark, sf):
    ask = F.element_at(F.array(*map(F.lit, ("POST /v1/messages?beta=1 HTTP/1.1", "POST /v1/chat/completions HTTP/1.1", "POST /v1/responses HTTP/1.1", "POST /v1/models HTTP/1.1"))), (F.col("k") % 4 + 1).cast("int"))
    return filters.streamed_llm(_texts(spark, sf).select("seq", ask.alias("request"), F.col("text").alias("response"))).select("seq")


@query(
    f"""{M} SELECT seq, CASE WHEN k - 50 <= 0 OR tgid % 3 = 0 THEN 0 ELSE least(k - 50, tgid % 3 * 200, 256) END::INT AS copied, greatest(k * 1000 - latency_ns, 0) AS late, k - 50 < 0 AS failed,
  CASE WHEN k % 2 = 0 THEN 'ns/' || src WHEN k % 3 = 0 THEN '10.0.0.1:80' ELSE 'unknown' END AS dst, k % 2 = 0 OR k % 4 = 3 AS keep, (k % 2) | (tgid % 8 & 6) AS merged,
  CASE WHEN k % 4 = 0 THEN 'grpc' ELSE 'h2' END AS protocol, CASE WHEN k % 2 = 0 THEN 'c' || k ELSE 'run' END AS process FROM m"""
)
def record_scalars(spark, sf):
    k = F.col("k")
    ret = (k - 50).cast("long")
    name = F.when(k % 2 == 0, F.col("src"))
    return messages(spark, sf).select(
        "seq", S.io_copy_len(ret, F.col("tgid") % 3 * 200).alias("copied"), S.latency(F.col("latency_ns"), k * 1000).alias("late"), S.is_syscall_error(ret).alias("failed"),
        S.dst_label(F.lit("ns"), name, F.when(k % 3 == 0, "10.0.0.1:80")).alias("dst"), S.keep_from_flags(F.when(k % 2 == 1, k % 4 * 2)).alias("keep"),
        S.merge_peer_flags(F.col("tgid") % 8, k % 2).alias("merged"), S.classify_protocol(F.when(k % 4 == 0, "/pkg.Service/Call").otherwise(F.col("path"))).alias("protocol"),
        S.process_name(F.when(k % 2 == 0, F.concat(F.lit(" c"), k.cast("string"))), F.lit("/usr/bin/run")).alias("process"),
    )


@query(
    f"""{M} SELECT seq, CASE k % 4 WHEN 0 THEN '10.0.0.' || k || ':443' WHEN 1 THEN '[fe80::' || format('{{:x}}', k) || ']:443' WHEN 2 THEN '[2001:db8::' || format('{{:x}}', k) || ':0:1]:443'
  ELSE '[::ffff:10.0.0.' || k || ']:443' END AS peer FROM m"""
)
def peer_labels(spark, sf):
    k, byte = F.col("k"), F.lpad(F.hex("k"), 2, "0")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("0A0000"), byte, F.lit("0" * 24)))
        .when(k % 4 == 1, F.concat(F.lit("FE80" + "0" * 26), byte))
        .when(k % 4 == 2, F.concat(F.lit("20010DB8" + "0" * 14), byte, F.lit("00000001")))
        .otherwise(F.concat(F.lit("0" * 20 + "FFFF0A0000"), byte))
    )
    family = F.when(k % 4 == 0, S.IPV4).otherwise(S.IPV6)
    return messages(spark, sf).select("seq", S.peer(family, F.unhex(text), F.lit(0xBB01)).alias("peer"))


# --- reports and cross-check inputs ---------------------------------------------------------------------------------------


@query(f"{X} SELECT count(*)::BIGINT AS total FROM x")
def total_requests(spark, sf):
    return A.total_requests(A.series_histogram(exchanges(spark, sf)))


@query("SELECT avg(c_acctbal) AS mean_cpu, max(c_custkey) AS max_rss FROM customer")
def resource_use(spark, sf):
    return A.resource_use(table(spark, sf, "customer").select(F.col("c_acctbal").alias("cpu"), F.col("c_custkey").alias("rss"))).select(F.col("mean_cpu").cast("double").alias("mean_cpu"), "max_rss")


@query(f"{M}, s AS (SELECT tgid, count(*) FILTER (event_type = 'error') AS n FROM m GROUP BY tgid) SELECT * FROM s WHERE n > 0")
def active_rows(spark, sf):
    return filters.active(messages(spark, sf).groupBy("tgid").agg(F.count_if(F.col("event_type") == "error").alias("n")))


_SHOWN = "CASE WHEN {0} >= 1000000 THEN printf('%.2fms', {0} / 1e6) WHEN {0} >= 1000 THEN printf('%.1fµs', {0} / 1e3) ELSE {0} || 'ns' END"


@query(
    f"""WITH c AS (SELECT conv_id, turn, length(text) AS v FROM conversations) SELECT 'llm_call path=/v1/messages status=200 ttfb=' || v || 'ns total=' || turn || 'ns in=' || v || ' out=' || CASE WHEN turn % 2 = 0 THEN turn::VARCHAR ELSE '-' END || ' complete=' || (turn % 3 = 0) AS line,
  v::VARCHAR AS input, CASE WHEN turn % 2 = 0 THEN turn::VARCHAR ELSE '-' END AS output FROM c WHERE v < 1000"""
)
def llm_lines(spark, sf):
    """The log line of each call, and its fields read back."""
    turn, v = F.col("turn").cast("long"), F.length("text").cast("long")
    calls = table(spark, sf, "conversations").where("length(text) < 1000").select(
        F.lit("/v1/messages").alias("path"), F.lit(200).alias("status"), v.alias("ttfb_ns"), turn.alias("total_ns"), v.alias("input_tokens"), F.when(turn % 2 == 0, turn).alias("output_tokens"), (turn % 3 == 0).alias("complete")
    )
    return genai.log_fields(genai.llm_line(calls)).select("line", F.col("fields")["in"].alias("input"), F.col("fields")["out"].alias("output"))


@query(f"{M}, r AS (SELECT CASE WHEN k % 2 = 0 THEN 'open' ELSE 'exec' END AS op, path FROM m WHERE tgid = 1) SELECT 'policy_violation op=' || op || ' path=' || path || ' rule=[\"deny_open /users/1\"]' AS line FROM r")
def violation_lines(spark, sf):
    found = messages(spark, sf).where("tgid = 1").select((F.col("k") % 2 + 1).alias("op"), "path", F.lit("deny_open /users/1").alias("rule"))
    return export.violation_line(found)


@query(f"{M}, r AS (SELECT src, dst, count(*) AS n, min(seq) AS p50_ns FROM m GROUP BY 1, 2 ORDER BY n DESC, src, dst LIMIT 20) SELECT src || ' ' || dst || ' n=' || n || ' p50=' || {_SHOWN.format('p50_ns')} AS line FROM r")
def headless_report(spark, sf):
    rows = messages(spark, sf).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("p50_ns"))
    return export.rendered_report(rows, ["src", "dst"], 20)


@query(f"{M} SELECT seq FROM m WHERE k % 3 = 0 AND k % 5 <> 0 AND event_type <> 'error' AND src LIKE '%3%'")
def gateway_rows(spark, sf):
    """A gateway's steps that can be compared, of one server."""
    k = F.col("k")
    steps = messages(spark, sf).select("seq", (k % 3 == 0).alias("is_stream"), F.when(k % 5 == 0, "cut").alias("fault"), F.when(F.col("event_type") == "error", "bad").otherwise("ok").alias("outcome"), F.col("src").alias("server"))
    return crosscheck.comparable(steps, "3").select("seq")


@query("SELECT 'pods' AS side, s_suppkey AS id FROM supplier UNION ALL SELECT 'services', n_nationkey FROM nation")
def refreshed_lists(spark, sf):
    """A refresh in which the services could not be listed keeps those that were known."""
    pods, known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))
    now, services = enrich.merge_lists(pods, None, (known, known))
    services = filters.keep_last_snapshot(services.limit(0), services, failed=True)
    return now.select(F.lit("pods").alias("side"), "id").unionByName(services.select(F.lit("services").alias("side"), "id"))


# --- rates of counters that start anew -----------------------------------------------------------------------------------

#: Counters start anew after this.
EPOCH = 3 * DAY


def bucket_points(spark, sf, value="latency_ns", keys=("dst", "route", "protocol"), rows=None):
    """Cumulative bucket counters by hour (keys, le, ts_ns, value), which start anew every EPOCH."""
    x = (exchanges(spark, sf) if rows is None else rows).withColumn("ts_ns", F.expr(f"t_end_ns - t_end_ns % {HOUR}"))
    if "route" in keys:
        x = x.withColumn("route", S.normalize_path(F.col("path")))
    hourly = x.groupBy(*keys, "ts_ns").agg(A.buckets(value).alias("buckets"))
    b = promql.cumulative_buckets(hourly, [*keys, "ts_ns"], DEFAULT.latency_bounds_ms)
    running = Window.partitionBy(*keys, "le", F.expr(f"ts_ns div {EPOCH}")).orderBy("ts_ns")
    return b.withColumn("value", F.sum("value").over(running))


_LE = f"le AS (SELECT unnest([{', '.join(f'{b}.0' for b in DEFAULT.latency_bounds_ms)}, 'inf'::DOUBLE]) AS le)"


def _increase_sql(points: str, series: str) -> str:
    """g (series, increase) over the last week of `points` (series, ts, value)."""
    return f"""a AS (SELECT max(ts) AS at0 FROM {points}), w AS (SELECT *, lag(value) OVER (PARTITION BY {series} ORDER BY ts) AS b FROM {points}, a WHERE ts > at0 - {WEEK} AND ts <= at0),
i AS (SELECT {series}, sum(CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END) AS raw, count(*) AS n, min(ts) AS f, max(ts) AS l, arg_min(value, ts) AS v0, any_value(at0) AS at0 FROM w GROUP BY {series} HAVING count(*) >= 2),
s AS (SELECT *, (l - f) / (n - 1) AS gap, f - (at0 - {WEEK}) AS room0, at0 - l AS room1 FROM i),
r AS (SELECT *, least(CASE WHEN room0 < gap * 1.1 THEN room0 ELSE gap / 2 END, CASE WHEN raw > 0 AND v0 >= 0 THEN (l - f) * (v0 / raw) ELSE 'inf'::DOUBLE END) AS r0, CASE WHEN room1 < gap * 1.1 THEN room1 ELSE gap / 2 END AS r1 FROM s),
g AS (SELECT {series}, raw * ((l - f + r0 + r1) / (l - f)) AS increase FROM r)"""


def _quantile_sql(q: float, where: str = "", by: str = "route", rows: str = f"SELECT dst, {ROUTE} AS route, protocol, t_end_ns, latency_ns FROM x", series: str = "dst, route, protocol, le") -> str:
    keys = series.removesuffix("le")
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""{X}, {_LE}, z AS ({rows}),
b AS (SELECT {keys} le, t_end_ns - t_end_ns % {HOUR} AS ts, count(*) FILTER (latency_ns / 1e6 <= le)::DOUBLE AS c FROM z, le {where} GROUP BY {keys} le, ts),
p AS (SELECT {keys} le, ts, sum(c) OVER (PARTITION BY {keys} le, ts // {EPOCH} ORDER BY ts) AS value FROM b),
{_increase_sql("p", series)},
h AS (SELECT {group} le, sum(increase / {WEEK / SECOND}) AS value FROM g GROUP BY {group} le),
o AS (SELECT {group} le, max(value) OVER ({part} ORDER BY le) AS value FROM h),
v AS (SELECT *, coalesce(lag(le) OVER k, 0.0) AS low, coalesce(lag(value) OVER k, 0.0) AS below, max(value) OVER ({part}) AS total FROM o WINDOW k AS ({part} ORDER BY le)),
f AS (SELECT *, row_number() OVER ({part} ORDER BY le) AS turn FROM v WHERE total > 0 AND value >= total * {q})
SELECT {group} round(CASE WHEN le = 'inf' THEN low ELSE low + (le - low) * (total * {q} - below) / (value - below) END, 6) AS quantile FROM f WHERE turn = 1"""


def _at_newest(points):
    return points.crossJoin(F.broadcast(points.agg(F.max("ts_ns").alias("newest"))))  # one row


def _rate_quantile(q, points, keys, by):
    return promql.rate_quantile(q, _at_newest(points), keys, by, F.col("newest"), WEEK).select(*by, F.round("quantile", 6).alias("quantile"))


@query(_quantile_sql(0.5, "WHERE protocol <> 'grpc'"))
def promql_http_p50(spark, sf):
    return _rate_quantile(0.5, bucket_points(spark, sf).where("protocol <> 'grpc'"), ["dst", "route", "protocol"], ["route"])


@query(_quantile_sql(0.99, "WHERE protocol <> 'grpc'"))
def promql_http_p99(spark, sf):
    return _rate_quantile(0.99, bucket_points(spark, sf).where("protocol <> 'grpc'"), ["dst", "route", "protocol"], ["route"])


@query(_quantile_sql(0.5, "WHERE protocol = 'grpc'"))
def promql_grpc_p50(spark, sf):
    return _rate_quantile(0.5, bucket_points(spark, sf).where("protocol = 'grpc'"), ["dst", "route", "protocol"], ["route"])


@query(_quantile_sql(0.99, "WHERE protocol = 'grpc'"))
def promql_grpc_p99(spark, sf):
    return _rate_quantile(0.99, bucket_points(spark, sf).where("protocol = 'grpc'"), ["dst", "route", "protocol"], ["route"])


@query(_quantile_sql(0.5, "", "", "SELECT src, ts_ns AS t_end_ns, latency_ns FROM m WHERE event_type = 'signup'", "src, le"))
def promql_handshake_p50(spark, sf):
    shakes = messages(spark, sf).where("event_type = 'signup'").withColumn("t_end_ns", F.col("ts_ns"))
    return _rate_quantile(0.5, bucket_points(spark, sf, keys=("src",), rows=shakes), ["src"], [])


_RESTARTED = f"""WITH {MESSAGES_SQL}, c AS (SELECT src, ts_ns - ts_ns % {HOUR} AS ts, count(*) AS c FROM m GROUP BY 1, 2), p AS (SELECT src, ts, sum(c) OVER (PARTITION BY src, ts // {EPOCH} ORDER BY ts)::DOUBLE AS value FROM c), {_increase_sql("p", "src")}"""


@query(f"{_RESTARTED} SELECT src, round(increase, 6) AS increase, round(increase / {WEEK / SECOND}, 9) AS rate FROM g")
def promql_resets(spark, sf):
    """Increase and rate of counters that start anew within the window."""
    hourly = messages(spark, sf).groupBy("src", F.expr(f"ts_ns - ts_ns % {HOUR}").alias("ts_ns")).agg(F.count(F.lit(1)).alias("c"))
    running = Window.partitionBy("src", F.expr(f"ts_ns div {EPOCH}")).orderBy("ts_ns")
    points = _at_newest(hourly.select("src", "ts_ns", F.sum("c").over(running).cast("double").alias("value")))
    found = promql.increase(points, ["src"], F.col("newest"), WEEK)
    return found.select("src", F.round("increase", 6).alias("increase"), F.round(F.col("increase") / (WEEK / SECOND), 9).alias("rate"))
