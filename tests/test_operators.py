import json
import random

import pytest
from pyspark.sql import functions as F

from wirelens.operators import aggregates, crosscheck, enrich, export, filters, pairing, policy, promql, ranks, reassembly, sampling, wire
from wirelens.sources import lists

MS = 1_000_000


def test_policy_text():
    rules = policy.parse_policy("# c\n\ndeny_open /home/agent/.ssh/\ndeny_exec nc\n")
    assert rules == [(0, "deny_open", "/home/agent/.ssh"), (1, "deny_exec", "nc")]
    for bad in ("deny_open home", "deny_exec /bin/nc", "deny_exec ", "allow /x", "deny_open"):
        with pytest.raises(policy.PolicyError):
            policy.parse_policy(bad)


def test_policy_rules(spark):
    rules = policy.rule_table(spark, "deny_open /home/agent/.ssh\ndeny_exec nc\n")
    ops = spark.createDataFrame([(1, 1, "/home/agent/.ssh/id"), (2, 1, "/home/agent/.sshd"), (3, 2, "/usr/bin/nc"), (4, 2, "/usr/bin/ncat"), (5, 1, "/home/agent/.ssh"), (6, 2, "/home/agent/.ssh")], "seq long, op int, path string")
    found = policy.violations(ops, rules)
    assert sorted(r.seq for r in found.collect()) == [1, 3, 5]
    assert policy.gate(found, spark.createDataFrame([(1,), (3,), (9,)], "seq long")).first().asDict() == {"detected": 2, "missing": 1, "unexpected": 1}
    assert "policy_violation op=open" in export.violation_line(found.where("seq = 1")).first().line


T0, T1 = 100 * MS, 150 * MS


@pytest.mark.parametrize(
    ("times", "outcome", "wire_ns"),
    [
        ([(T0 - MS, "W"), (T1 - MS, "R")], "hit", 50 * MS),
        ([(T0 - MS, "W"), (T1 + 2 * MS, "R")], "fallback", 53 * MS),
        ([(T0 - 6 * MS, "W"), (T1, "R")], "miss", None),
        ([(T0, "W"), (T0, "R")], "miss", None),
        ([(T0 - 4 * MS, "W"), (T0 - 2 * MS, "W"), (T1, "R"), (T1 - 4 * MS, "R")], "hit", 52 * MS),
    ],
)
def test_dual_plane(spark, times, outcome, wire_ns):
    x = spark.createDataFrame([(1, 7, 3, T0, T1, "W", "R")], "xid long, tgid long, fd int, t0 long, t1 long, start_dir string, end_dir string")
    t = spark.createDataFrame([(7, 3, ts, d) for ts, d in times], "tgid long, fd int, ts_ns long, dir string")
    got = wire.dual_plane(x, t).first()
    assert (got.outcome, got.wire_ns) == (outcome, wire_ns)


def test_handshake_is_used_once_and_only_the_latest(spark):
    spans = spark.createDataFrame([(1, 7, 3, 100, 200), (2, 7, 3, 300, 400), (3, 7, 4, 10, 50)], "seq long, tgid long, fd int, t_start_ns long, t_end_ns long")
    hs = spark.createDataFrame([(1, 7, 3, 50, 5), (2, 7, 4, 20, 9)], "hs_id long, tgid long, fd int, ts_ns long, latency_ns long")
    got = {r.seq: r.handshake_ns for r in wire.handshake_once(spans, hs).collect()}
    assert got == {1: 5, 2: None, 3: None}


def test_top_frames(spark):
    spans = spark.createDataFrame([(1, 7, 0, 50 * MS), (2, 7, 0, 5 * MS)], "span long, tgid long, t0 long, t1 long")
    stacks = spark.createDataFrame([(7, k * MS, ["hot", "cold"]) for k in (1, 2, 3)] + [(7, 4 * MS, ["cold"]), (8, 1, ["x"])], "tgid long, ts_ns long, frames array<string>")
    assert [(r.frame, r.n) for r in wire.top_frames(spans, stacks).orderBy("rank").collect()] == [("cold", 4), ("hot", 3)]


def test_reassembly(spark):
    rows = [
        (7, 3, "W", 1, 10, "GET /slow HTTP/1.1\r\n"),
        (7, 3, "W", 3, 20, "Host: x\r\n\r\n"),
        (7, 3, "R", 2, 100, "HTTP/1.1 200 OK\r\n"),
        (7, 3, "R", 4, 250, "\r\n"),
        (7, 3, "R", 5, 260, "SSH-2.0\r\n\r\n"),
        (7, 4, "W", 6, 10, "GET /a HTTP/1.1\r\n"),
        (7, 4, "W", 7, 10 + 60_000_000_001, "late\r\n\r\n"),
    ]
    chunks = spark.createDataFrame([(*r, 3, 1, 0) for r in rows], "tgid long, fd int, dir string, seq long, ts_ns long, text string, kind int, pid long, cgroup_id long")
    got = sorted((r.dir, r.ts_ns, r.text) for r in reassembly.reassemble(chunks).collect())
    assert got == [("R", 250, "HTTP/1.1 200 OK\r\n\r\n"), ("W", 10, "GET /slow HTTP/1.1\r\nHost: x\r\n\r\n")]
    long = spark.createDataFrame([(1, 1, "W", 1, 1, "GET /" + "a" * 9000, 3, 1, 0)], chunks.schema)
    assert len(reassembly.reassemble(long).first().text) == 256


def test_pairing_vectors(spark):
    rows = [(1, 7, 3, 1000, "W", "GET", "/", None), (2, 7, 3, 1_050_000_000, "R", None, None, 200), (3, 8, 3, 10, "R", "POST", "/p", None), (4, 8, 3, 500, "W", None, None, 201)]
    m = spark.createDataFrame(rows, "seq long, tgid long, fd int, ts_ns long, dir string, method string, path string, status int").withColumns(
        {"ret": F.lit(0), "is_request": F.col("method").isNotNull(), "is_response": F.col("status").isNotNull()}
    )
    assert sorted((r.latency_ns, r.is_client) for r in pairing.pair_http(m).collect()) == [(490, False), (1_049_999_000, True)]
    assert [r.tgid for r in pairing.pair_http(m, client_only=True).collect()] == [7]


def test_statistics(spark):
    x = spark.createDataFrame([(k, "GET", "/a", "http", s, 50 * MS, None, k) for k, s in enumerate((200, 200, 404, 500))], "seq long, method string, path string, protocol string, status int, latency_ns long, wire_ns long, t_end_ns long")
    got = aggregates.http_endpoints(x).first()
    assert (got.n, got.pct_4xx, got.pct_5xx, got.wire_p50_ns) == (4, 25.0, 25.0, None)
    sockets = spark.createDataFrame([("a", 61_000_000_001, 0, 5), ("a", 61_000_000_000, -115, 5), ("a", 1_000_000_000, 0, 5)], "label string, ts_ns long, ret long, latency_ns long")
    got = aggregates.tcp_endpoints(sockets).first()
    assert (got.n, got.errors) == (2, 1)
    assert spark.createDataFrame([(50 * MS,)], "v long").agg(aggregates.buckets("v").alias("b")).first().b.index(1) == 5


def test_caps_put_late_keys_together(spark):
    x = spark.createDataFrame([(k, f"s{k}") for k in range(10)], "seq long, src string")
    got = {r.src: r.overflow for r in aggregates.capped_keys(x, ["src"], 7).collect()}
    assert sorted(got) == ["_other", *(f"s{k}" for k in range(7))]


def test_small_quantile_rules(spark):
    v = spark.createDataFrame([(float(k),) for k in (5, 1, 4, 2, 3, 6)], "v double")
    assert [v.agg(aggregates.sorted_index("v", rule, 0.5).alias("x")).first().x for rule in ("half", "round", "floor")] == [4.0, 4.0, 4.0]
    assert ranks.value_at(v, 0.9, "x").first().x == 6.0


def test_filters(spark):
    assert filters.parse_comm_list(" a, ,b,") == ["a", "b"]
    c = spark.createDataFrame([("nginx",), ("kubelet",), ("wirelens",)], "comm string")
    allowed = lambda **k: sorted(r.comm for r in c.where(filters.comm_allowed(F.col("comm"), **k)).collect())
    assert allowed() == ["kubelet", "nginx"]
    assert allowed(k8s=True) == ["nginx"]
    assert allowed(allow=["kubelet", "wirelens"]) == ["kubelet"]


def test_emit_gate(spark):
    rows = [(1, 1, 1, "junk", False), (1, 1, 2, "GET / HTTP/1.1", False), (1, 1, 3, "body", False), (1, 1, 4, "", True), (1, 1, 5, "junk", False)]
    df = spark.createDataFrame(rows, "tgid long, fd int, seq long, text string, cleared boolean")
    assert [r.seq for r in filters.emit_gate(df).orderBy("seq").collect()] == [2, 3]


def test_sample_controller(spark):
    ticks = spark.createDataFrame([("n", k, 1 if k < 5 else 0) for k in range(70)], "node string, tick long, drops long")
    got = [r.n for r in sampling.sample_controller(ticks).orderBy("tick").collect()]
    assert got[:5] == [2, 4, 8, 16, 16]
    assert (got[33], got[34], got[64]) == (16, 8, 4)


def test_cluster_lists(spark):
    pod = lambda name, ip, **k: {"metadata": {"uid": name, "namespace": "d", "name": name} | ({"deletionTimestamp": "t"} if k.get("gone") else {}), "spec": {"hostNetwork": k.get("host", False)}, "status": {"phase": k.get("phase", "Running"), "podIP": ip, "podIPs": [{"ip": ip}, {"ip": "fd00::1"}]}}
    pages = spark.createDataFrame(
        [(json.dumps({"items": [pod("a", "10.0.0.1"), pod("b", "10.0.0.2", host=True), pod("c", "10.0.0.3", phase="Pending"), pod("e", "10.0.0.4", gone=True)]}),), ("not json",)], "value string"
    )
    assert [(r.ip, r.name) for r in enrich.pod_ips(pages).collect()] == [("10.0.0.1", "a")]
    assert enrich.pod_table(pages).count() == 4
    services = spark.createDataFrame([(json.dumps({"items": [{"metadata": {"namespace": "d", "name": n}, "spec": {"clusterIP": ip}} for n, ip in (("s", "10.1.0.1"), ("h", "None"), ("x", ""), ("v6", "fd00::2"))]}),)], "value string")
    assert [(r.ip, r.name) for r in enrich.service_ips(services).collect()] == [("10.1.0.1", "s")]
    both = enrich.with_dst(spark.createDataFrame([("10.0.0.1", 80), ("10.1.0.1", 80), ("9.9.9.9", 1), (None, 0)], "ip string, port int"), enrich.pod_ips(pages), enrich.service_ips(services))
    assert sorted(r.dst for r in both.collect()) == ["9.9.9.9:1", "d/a", "d/s", "unknown"]


def test_greedy_prefers_the_longest_then_the_nearest(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, 10.1), (3, 50.0)], "row_id long, ts double")
    spans = spark.createDataFrame([(1, 10.05, 5.0), (2, 10.2, 9.0), (3, 10.0, 9.0)], "span_id long, end double, total double")
    pairs = crosscheck.candidates(rows, spans, 0.4).withColumn("g", F.lit(1))
    got = crosscheck.greedy(pairs, "g", 0.4)
    assert sorted(map(tuple, got.collect())) == [(1, 3), (2, 2)]
    assert [r.row_id for r in crosscheck.unmatched(rows, got, "row_id").collect()] == [3]


def test_query_language(spark):
    points = spark.createDataFrame([("a", 0, 0.0), ("a", 30, 10.0), ("a", 60, 4.0)], "s string, t long, value double").select("s", (F.col("t") * 1_000_000_000).alias("ts_ns"), "value")
    got = promql.increase(points, ["s"], F.lit(60_000_000_000), 120_000_000_000).first()
    assert got.increase == pytest.approx(14.0)  # a reset counts from 0; the start isn't extended below 0
    b = spark.createDataFrame([("r", 1.0, 0.0), ("r", 2.0, 10.0), ("r", float("inf"), 10.0)], "r string, le double, value double")
    assert promql.histogram_quantile(0.5, b, ["r"]).first().quantile == 1.5


def test_endpoints():
    assert export.endpoint("http://c:4318", "metrics") == "http://c:4318/v1/metrics"
    assert export.endpoint("http://c:4318/v1/metrics/", "traces") == "http://c:4318/v1/traces"


def test_documents_are_json(spark):
    schema = "seq long, trace_id string, span_id string, name string, kind_client boolean, start_unix_ns long, end_unix_ns long, src string, dst string, method string, route string, protocol string, status int, wire_ns long, handshake_ns long, profile_frames array<string>, llm struct<provider:string,input_tokens:long,output_tokens:long,ttfb_ns:long,complete:boolean>"
    rows = [(1, "a" * 32, "b" * 16, 'GET "x"', True, 1, 2, "", "d", "GET", "/x", "grpc", 200, 5, None, ["f", "g"], None), (2, "a" * 32, "b" * 16, "chat", True, 1, 2, "s", "d", "POST", "/v1", "http/1.1", 200, None, None, None, ("openai", 3, None, 7, True))]
    doc = json.loads(export.traces_json(spark.createDataFrame(rows, schema)).first().json)
    groups = doc["resourceSpans"]
    assert [g["resource"]["attributes"][0]["value"]["stringValue"] for g in groups] == ["unknown", "s"]
    first = groups[0]["scopeSpans"][0]["spans"][0]
    assert (first["name"], first["status"]["code"], first["events"][0]["attributes"][1]["value"]["stringValue"]) == ('GET "x"', 2, "g")
    lines = spark.createDataFrame([("/v1/traces " + json.dumps(doc),), ("/v1/metrics {}",)], "value string")
    got = export.sink_spans(lines).first()
    assert (got.input_tokens, got.output_tokens, got.complete, got.server) == (3, None, "true", "d")
    counters = spark.createDataFrame([("wirelens.events_dropped", "sum", 3), ("wirelens.sample_n", "gauge", 1)], "name string, kind string, value long")
    metrics = json.loads(export.metrics_json(export.counter_points(counters, 0, 9)).first().json)
    assert [m["name"] for m in metrics["resourceMetrics"][0]["scopeMetrics"][0]["metrics"]] == ["wirelens.events_dropped", "wirelens.sample_n"]


def test_lists_come_in_pages(spark):
    item = lambda name: {"metadata": {"uid": name, "namespace": "d", "name": name}}
    served = {None: ("a", "1"), "1": ("b", "2"), "2": ("c", "")}
    fetch = lambda token: json.dumps({"items": [item(served[token][0])], "metadata": {"continue": served[token][1]}})
    assert sorted(r.uid for r in enrich.pod_table(lists.listed(spark, fetch)).collect()) == ["a", "b", "c"]
    assert len(list(lists.pages(fetch, 3))) == 3
    with pytest.raises(lists.ListError):
        list(lists.pages(fetch, 2))

    def broken(token):
        raise OSError("no answer")

    assert lists.listed(spark, fetch, 2) is None and lists.listed(spark, broken) is None
    assert lists.listed(spark, lambda token: json.dumps({"items": []})).count() == 1


def test_greedy_in_runs_equals_one_fold(spark):
    draw = random.Random(4)
    rows = spark.createDataFrame([(k, draw.choice("ab"), draw.uniform(0, 400)) for k in range(300)], "row_id long, g string, ts double")
    spans = spark.createDataFrame([(k, draw.choice("ab"), draw.uniform(0, 400), float(draw.randint(1, 5))) for k in range(300)], "span_id long, g string, end double, total double")
    pairs = crosscheck.candidates(rows, spans, 1.0, "g")
    held, used, want = pairs.collect(), set(), []
    for row in rows.orderBy("ts", "row_id").collect():
        free = sorted((-p.total, p.gap, p.span_id) for p in held if p.row_id == row.row_id and p.span_id not in used)
        if free:
            used.add(free[0][2])
            want.append((row.row_id, free[0][2]))
    assert sorted(map(tuple, crosscheck.greedy(pairs, "g", 1.0).collect())) == sorted(want)
