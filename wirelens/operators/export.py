"""Exports: metric and trace documents, reports, endpoints of a collector."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import scalars as S

SCOPE = "wirelens"


def _text(key: str, value: Column) -> Column:
    return F.to_json(F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias("stringValue")).alias("value")))


def _int(key: str, value: Column) -> Column:
    return F.to_json(F.struct(F.lit(key).alias("key"), F.struct(value.cast("long").cast("string").alias("intValue")).alias("value")))


def _list(parts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def with_span_ids(x: DataFrame) -> DataFrame:
    """x(tgid, fd, stream_id, t_start_ns) with trace_id (128 bits) and span_id (64 bits) in hex."""
    t = F.col("t_start_ns")
    turned = F.shiftleft(t, 17).bitwiseOR(F.shiftrightunsigned(t, 47))
    a = S.splitmix64(t.bitwiseXOR(F.shiftleft(F.col("tgid").cast("long"), 32)).bitwiseXOR(F.col("fd").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    b = S.splitmix64(F.col("__a").bitwiseXOR(F.shiftleft(F.col("stream_id").cast("long"), 32)).bitwiseXOR(turned))
    # Fixed value: what the span's id is mixed with.
    c = S.splitmix64(F.col("__b").bitwiseXOR(F.lit(0xA5A5A5A5A5A5A5A5 - (1 << 64))))
    return (
        x.withColumn("__a", a)
        .withColumn("__b", b)
        .withColumn("__c", c)
        .withColumn("trace_id", F.concat(S.hex64(F.col("__a")), S.hex64(F.col("__b"))))
        .withColumn("span_id", S.hex64(F.col("__c")))
        .drop("__a", "__b", "__c")
    )


def span_json(prefix: str = SCOPE) -> Column:
    """The JSON text of a span row: ids, name, kind_client, start, end, src, dst, method, route, protocol, status, and
    wire_ns, handshake_ns, profile_frames, llm (provider, input_tokens, output_tokens, ttfb_ns, complete), which may be null."""
    when = lambda c, made: F.when(F.col(c).isNotNull(), made)
    attributes = F.array_compact(
        F.array(
            *[_text(k, F.col(c)) for k, c in (("src", "src"), ("dst", "dst"), ("http.method", "method"), ("http.route", "route"), (f"{prefix}.protocol", "protocol"))],
            F.when(F.col("protocol") == "grpc", _int("rpc.grpc.status_code", F.col("status"))).otherwise(_int("http.status_code", F.col("status"))),
            when("wire_ns", _int(f"{prefix}.wire_latency_ns", F.col("wire_ns"))),
            when("handshake_ns", _int(f"{prefix}.tls.handshake_ns", F.col("handshake_ns"))),
            when("llm", _text("gen_ai.operation.name", F.lit("chat"))),
            when("llm", _text("gen_ai.provider.name", F.col("llm.provider"))),
            when("llm", _text("server.address", F.col("dst"))),
            when("llm.input_tokens", _int("gen_ai.usage.input_tokens", F.col("llm.input_tokens"))),
            when("llm.output_tokens", _int("gen_ai.usage.output_tokens", F.col("llm.output_tokens"))),
            when("llm", _int(f"{prefix}.llm.ttfb_ns", F.col("llm.ttfb_ns"))),
            when("llm", _text(f"{prefix}.llm.complete", F.col("llm.complete"))),
        )
    )
    frames = F.transform("profile_frames", lambda f, k: F.to_json(F.struct(F.concat(F.lit("frame."), k.cast("string")).alias("key"), F.struct(f.alias("stringValue")).alias("value"))))
    event = F.concat(F.lit(',"events":[{"timeUnixNano":"'), F.col("end_unix_ns").cast("string"), F.lit('","name":"profile","attributes":'), _list(frames), F.lit("}]"))
    return F.concat(
        F.lit('{"traceId":"'), "trace_id", F.lit('","spanId":"'), "span_id", F.lit('","name":'), F.substring(F.to_json(F.array("name")), F.lit(2), F.length(F.to_json(F.array("name"))) - 2),
        F.lit(',"kind":'), F.when(F.col("kind_client"), F.lit("3")).otherwise(F.lit("2")), F.lit(',"startTimeUnixNano":"'), F.col("start_unix_ns").cast("string"),
        F.lit('","endTimeUnixNano":"'), F.col("end_unix_ns").cast("string"), F.lit('","status":{"code":'), S.span_otel_status(F.col("protocol"), F.col("status")).cast("string"),
        F.lit('},"attributes":'), _list(attributes), F.when(F.size("profile_frames") > 0, event).otherwise(F.lit("")), F.lit("}"),
    )


def traces_json(spans: DataFrame, per_document: int = DEFAULT.span_queue, scope: str = SCOPE) -> DataFrame:
    """document, json: trace documents of at most per_document spans (seq, src and the columns of span_json).

    Within a document, spans are grouped by service in the order of its first span; a service without a name is "unknown".
    """
    named = spans.withColumn("svc", F.when(F.coalesce("src", F.lit("")) == "", F.lit("unknown")).otherwise(F.col("src")))
    rows = named.select(F.floor(F.col("seq") / per_document).alias("document"), "svc", "seq", span_json(scope).alias("span"))
    groups = rows.groupBy("document", "svc").agg(F.min("seq").alias("first"), F.sort_array(F.collect_list(F.struct("seq", "span"))).alias("spans"))
    body = F.concat(
        F.lit('{"resource":{"attributes":'), _list(F.array(_text("service.name", F.col("svc")), _text("telemetry.sdk.name", F.lit(scope)))),
        F.lit(f'}},"scopeSpans":[{{"scope":{{"name":"{scope}","version":"0.1.0"}},"spans":'), _list(F.transform("spans", lambda s: s["span"])), F.lit("}]}"),
    )
    parts = groups.select("document", "first", "svc", body.alias("body")).groupBy("document").agg(F.sort_array(F.collect_list(F.struct("first", "svc", "body"))).alias("all"))
    return parts.select("document", F.concat(F.lit('{"resourceSpans":'), _list(F.transform("all", lambda p: p["body"])), F.lit("}")).alias("json"))


def _point(start: Column, now: Column, body: list[Column], attributes: Column | None) -> Column:
    parts = [F.lit('{"startTimeUnixNano":"'), start.cast("string"), F.lit('","timeUnixNano":"'), now.cast("string"), F.lit('",'), *body]
    return F.concat(*parts, *([F.lit(',"attributes":'), attributes] if attributes is not None else []), F.lit("}"))


def histogram_point(start: Column, now: Column, attributes: Column | None) -> Column:
    """Of rows with n, sum_ns and buckets."""
    bounds = ",".join(map(str, DEFAULT.latency_bounds_ms))
    counts = F.array_join(F.transform("buckets", lambda b: F.concat(F.lit('"'), b.cast("string"), F.lit('"'))), ",")
    body = [F.lit('"count":"'), F.col("n").cast("string"), F.lit('","sum":'), (F.col("sum_ns") / 1e6).cast("string"), F.lit(',"bucketCounts":['), counts, F.lit(f'],"explicitBounds":[{bounds}]')]
    return _point(start, now, body, attributes)


def number_point(value: Column, start: Column, now: Column, attributes: Column | None) -> Column:
    return _point(start, now, [F.lit('"asInt":"'), value.cast("long").cast("string"), F.lit('"')], attributes)


#: The dimensions of a series as attribute names.
SERIES = {"src": "src", "dst": "dst", "http.method": "method", "http.route": "route", "http.status_class": "status_class", "http.protocol": "protocol"}


def metric_points(series: DataFrame, start_ns: int, now_ns: int) -> DataFrame:
    """metric, kind, point: the data points (JSON) of series rows (SERIES columns, n, sum_ns, buckets, errors)."""
    start, now = F.lit(start_ns), F.lit(now_ns)
    attributes = _list(F.array(*[_text(k, F.col(c)) for k, c in SERIES.items()]))
    points = F.array(
        F.struct(F.lit("http.client.duration").alias("metric"), F.lit("histogram").alias("kind"), histogram_point(start, now, attributes).alias("point")),
        F.struct(F.lit("http.client.requests").alias("metric"), F.lit("sum").alias("kind"), number_point(F.col("n"), start, now, attributes).alias("point")),
        F.struct(F.lit("http.client.errors").alias("metric"), F.lit("sum").alias("kind"), F.when(F.col("errors") > 0, number_point(F.col("errors"), start, now, attributes)).alias("point")),
    )
    return series.select(F.explode(points).alias("p")).select("p.*").where("point IS NOT NULL")


def counter_points(counters: DataFrame, start_ns: int, now_ns: int) -> DataFrame:
    """The points of agent counters and gauges: name, kind (sum or gauge), value."""
    start, now = F.lit(start_ns), F.lit(now_ns)
    gauge = F.concat(F.lit('{"timeUnixNano":"'), now.cast("string"), F.lit('","asInt":"'), F.col("value").cast("string"), F.lit('"}'))
    return counters.select(F.col("name").alias("metric"), "kind", F.when(F.col("kind") == "gauge", gauge).otherwise(number_point(F.col("value"), start, now, None)).alias("point"))


def metrics_json(points: DataFrame, scope: str = SCOPE) -> DataFrame:
    """document, json: one cumulative metric document of points (metric, kind, point); the series cap bounds its size."""
    one = points.withColumn("document", F.lit(0)).groupBy("document", "metric", "kind").agg(F.sort_array(F.collect_list("point")).alias("points"))
    extra = F.when(F.col("kind") == "gauge", "").when(F.col("kind") == "sum", '"aggregationTemporality":2,"isMonotonic":true,').otherwise('"aggregationTemporality":2,')
    unit = F.when(F.col("kind") == "histogram", "ms").otherwise("1")
    body = F.concat(F.lit('{"name":"'), "metric", F.lit('","unit":"'), unit, F.lit('","'), "kind", F.lit('":{'), extra, F.lit('"dataPoints":'), _list(F.col("points")), F.lit("}}"))
    all_ = one.select("document", F.struct("metric", body.alias("body")).alias("m")).groupBy("document").agg(F.sort_array(F.collect_list("m")).alias("all"))
    head = f'{{"resourceMetrics":[{{"resource":{{"attributes":[{{"key":"service.name","value":{{"stringValue":"{scope}"}}}}]}},"scopeMetrics":[{{"scope":{{"name":"{scope}","version":"0.1.0"}},"metrics":'
    return all_.select("document", F.concat(F.lit(head), _list(F.transform("all", lambda m: m["body"])), F.lit("}]}]}")).alias("json"))


def endpoint(base: str, signal: str) -> str:
    """The URL of a signal (metrics or traces) from a collector's base URL or from the other signal's URL."""
    parts = urlsplit(base if "//" in base else f"http://{base}")
    path = parts.path.rstrip("/")
    for other in ("/v1/metrics", "/v1/traces"):
        path = path.removesuffix(other)
    return urlunsplit((parts.scheme, parts.netloc, f"{path}/v1/{signal}", "", ""))


def post(documents: DataFrame, url: str, timeout: float = 5.0) -> dict[str, int]:
    """Sends each document from the task that holds it; failures are counted, not tried again; without documents nothing is sent."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import urllib.request

        for pdf in batches:
            done = []
            for text in pdf["json"]:
                request = urllib.request.Request(url, text.encode(), {"Content-Type": "application/json"})
                try:
                    with urllib.request.urlopen(request, timeout=timeout):
                        done.append(True)
                except OSError:
                    done.append(False)
            yield pd.DataFrame({"done": done})

    told = documents.where("json IS NOT NULL").select("json").mapInPandas(send, "done boolean")
    row = told.agg(F.count_if("done").alias("sent"), F.count_if(~F.col("done")).alias("failed")).first()
    return row.asDict()


def sink_spans(lines: DataFrame, prefix: str = SCOPE) -> DataFrame:
    """Chat spans of a trace sink's lines, `<path> <json>`: end, total_ms, ttfb_ms, tokens (or null), complete, server."""
    kv = "array<struct<key:string,value:struct<stringValue:string,intValue:string>>>"
    schema = f"resourceSpans array<struct<scopeSpans:array<struct<spans:array<struct<name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{kv}>>>>>>"
    body = F.substring("value", F.instr("value", " ") + 1, F.length("value"))
    spans = (
        lines.where(F.split_part("value", F.lit(" "), F.lit(1)) == "/v1/traces")
        .select(F.from_json(body, schema).alias("j"))
        .select(F.explode("j.resourceSpans").alias("r"))
        .select(F.explode("r.scopeSpans").alias("s"))
        .select(F.explode("s.spans").alias("s"))
        .where("s.name = 'chat'")
    )
    a = spans.withColumn("a", F.map_from_entries(F.transform("s.attributes", lambda x: F.struct(x["key"], F.coalesce(x["value"]["stringValue"], x["value"]["intValue"])))))
    end, start = F.col("s.endTimeUnixNano").cast("long"), F.col("s.startTimeUnixNano").cast("long")
    number = lambda k: F.col("a")[k].cast("long")
    return a.select(
        (end / 1e9).alias("end"),
        ((end - start) / 1e6).alias("total_ms"),
        (number(f"{prefix}.llm.ttfb_ns") / 1e6).alias("ttfb_ms"),
        number("gen_ai.usage.input_tokens").alias("input_tokens"),
        number("gen_ai.usage.output_tokens").alias("output_tokens"),
        F.col("a")[f"{prefix}.llm.complete"].alias("complete"),
        F.coalesce(F.col("a")["server.address"], F.lit("")).alias("server"),
    )


def violation_line(found: DataFrame) -> DataFrame:
    return found.select(F.concat(F.lit("policy_violation op="), F.when(F.col("op") == 1, "open").otherwise("exec"), F.lit(" path="), "path", F.lit(" rule="), F.to_json(F.array("rule"))).alias("line"))


def rendered_report(table: DataFrame, label: list[str], top: int) -> DataFrame:
    """The lines of a headless report: a table's largest rows."""
    return (
        table.orderBy(F.desc("n"), *label)
        .limit(top)
        .select(F.concat_ws(" ", *label, F.concat(F.lit("n="), F.col("n").cast("string")), F.concat(F.lit("p50="), S.fmt_ns(F.col("p50_ns")))).alias("line"))
    )
