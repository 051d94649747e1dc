import random
import struct

import pytest

from wirelens.plans import replay
from wirelens.sources import evlog
from wirelens.streaming import queries as streaming

SLOW, REPLY = b"GET /slow HTTP/1.1\r\nHost: x\r\n\r\n", b"HTTP/1.1 200 OK\r\n\r\n"
SSE = b"HTTP/1.1 200 OK\r\nContent-Type: text/event-stream\r\n\r\n"
ASK = b"POST /v1/messages?beta=1 HTTP/1.1\r\nHost: api\r\n\r\n"


def io(direction, ts, text, tgid=7, fd=3, kind=3, ret=None):
    n = len(text) if ret is None else ret
    return struct.pack("<BBHiIIqQQ256s", kind, 1 if direction == "R" else 2, min(len(text), 256), fd, tgid, tgid, n, ts, 0, text[:256])


def frame(spark, records):
    return spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(records)], "seq long, rec binary")


def run(spark, records):
    exchanges, calls = replay.replay(frame(spark, records))
    return exchanges.orderBy("tgid", "t_start_ns").collect(), calls.orderBy("t_start_ns").collect()


def slow_log(n=15):
    out = []
    for k in range(n):
        t = (k + 1) * 1_000_000_000
        out += [io("W", t, SLOW), io("R", t + 50_000_000 + k * 100_000, REPLY)]
    return out


def test_golden_log(spark):
    rows = replay.report(frame(spark, slow_log())).collect()
    assert [(r.label, r.status, r.n) for r in rows] == [("GET /slow", 200, 15)]
    assert 45_000_000 <= rows[0].p50_ns <= 56_000_000


def test_same_result_however_it_is_dealt(spark):
    records = [io(d, t, x, tgid=g) for g in range(6) for d, t, x in (("W", 1, SLOW), ("R", 900, REPLY), ("W", 2000, SLOW), ("R", 2500, b"HTTP/1.1 404 no\r\n\r\n"))]
    df = frame(spark, records)
    want = None
    for n in (1, 2, 8):
        got = sorted(map(tuple, replay.replay(df.repartition(n))[0].collect()), key=repr)
        want = want or got
        assert got == want
    assert len(want) == 12


@pytest.mark.parametrize("loss", [0.0, 0.1, 0.5])
def test_pairs_whose_halves_survive_are_found(spark, loss):
    random.seed(int(loss * 10))
    records, whole = [], 0
    for k in range(200):
        a, b = random.random() >= loss, random.random() >= loss
        records += [io("W", 10 * k, SLOW, fd=k)] * a + [io("R", 10 * k + 5, REPLY, fd=k)] * b
        whole += a and b
    assert len(run(spark, records)[0]) == whole


def test_split_headers_and_server_side(spark):
    exchanges, _ = run(spark, [io("R", 10, b"GET /a HTTP/1.1\r\n"), io("R", 20, b"Host: x\r\n\r\n"), io("W", 500, b"HTTP/1.1 201 C\r\n"), io("W", 600, b"\r\n")])
    assert [(x.path, x.status, x.latency_ns, x.is_client) for x in exchanges] == [("/a", 201, 590, False)]


def test_wait_ends_with_any_other_message_or_the_ttl(spark):
    exchanges, _ = run(spark, [io("W", 1, SLOW), io("W", 2, SLOW), io("R", 5, REPLY), io("R", 6, REPLY), io("W", 7, SLOW), io("R", 7 + 60_000_000_001, REPLY)])
    assert [(x.t_start_ns, x.latency_ns) for x in exchanges] == [(2, 3)]


def test_tls_keeps_client_requests_only(spark):
    exchanges, _ = run(spark, [io("R", 1, SLOW, kind=4), io("W", 2, REPLY, kind=4), io("W", 3, SLOW, kind=4), io("R", 9, REPLY, kind=4)])
    assert [x.latency_ns for x in exchanges] == [6]


def test_model_stream(spark):
    chunks = [
        io("W", 0, ASK),
        io("R", 300, SSE),
        io("R", 340, b'data: {"type":"message_start","usage":{"input_tokens":25,"output_tokens":1}}'),
        io("R", 380, b'{"type":"message_delta","usage":{"output_tokens": 15}}'),
        io("R", 400, b'{"type":"message_stop"}'),
        io("R", 500, REPLY),
        io("W", 600, ASK),
        io("R", 700, SSE),
        io("R", 800, b'{"usage":{"prompt_tokens":11,"completion_tokens":22}}'),
        io("W", 900, SLOW),
        io("R", 950, REPLY),
    ]
    exchanges, calls = run(spark, chunks)
    assert [(c.ttfb_ns, c.total_ns, c.input_tokens, c.output_tokens, c.complete, c.provider) for c in calls] == [
        (300, 400, 25, 15, True, "anthropic"),
        (100, 200, 11, 22, False, "anthropic"),
    ]
    assert [x.path for x in exchanges] == ["/v1/messages", "/v1/messages", "/slow"]


def test_open_stream_is_given_at_the_end(spark):
    _, calls = run(spark, [io("W", 0, ASK), io("R", 3, SSE)])
    assert [(c.total_ns, c.input_tokens, c.complete) for c in calls] == [(3, None, False)]


def test_random_records_never_fail(spark):
    random.seed(9)
    records = [random.randbytes(random.choice((0, 1, 32, 48, 96, 160, 296))) for _ in range(3000)]
    records += [bytes([random.choice((3, 4))]) + random.randbytes(295) for _ in range(1000)]
    df = frame(spark, records)
    for decode in (evlog.decode_io, evlog.decode_socket, evlog.decode_times, evlog.decode_handshake, evlog.decode_stacks, evlog.decode_file_ops):
        decode(df).collect()
    replay.report(df).collect()


def test_log_round_trip_redacts(spark, tmp_path):
    evlog.register(spark)
    secret = io("W", 5, b"GET / HTTP/1.1\r\nCookie: a=1\r\n\r\n")
    other = struct.pack("<B7xIIqQQIH2x", 1, 1, 2, -115, 5000, 9, 0, 0)
    path = str(tmp_path / "log")
    frame(spark, [secret, other]).coalesce(1).select("rec").write.format("evlog").mode("append").save(path)
    back = spark.read.format("evlog").load(path).orderBy("seq").collect()
    assert [bytes(r.rec) for r in back] == [secret.replace(b"a=1", b"***"), other]
    assert [bytes(r.rec) for r in evlog.read_logs(spark, path).orderBy("seq").collect()] == [bytes(r.rec) for r in back]


def test_bad_logs():
    with pytest.raises(evlog.LogError):
        list(evlog.records(b"OTHER\n\n\n"))
    assert list(evlog.records(evlog.MAGIC + b"\x05\x00")) == []
    with pytest.raises(evlog.LogError):
        list(evlog.records(evlog.MAGIC + struct.pack("<I", 9) + b"short"))


def test_decoding(spark):
    rows = frame(
        spark,
        [
            struct.pack("<B7xIIqQQIH2x", 2, 11, 12, -1, 5, 6, int.from_bytes(bytes([127, 0, 0, 1]), "little"), 0x5000),
            struct.pack("<BBHiIIqQ", 5, 1, 0, -2, 1, 2, 3, 4),
            struct.pack("<B7xIIiIqQQ", 6, 1, 2, 9, 0, 1, 77, 88),
            struct.pack("<B7xIIQB7x8Q", 7, 21, 22, 5, 2, 1, (1 << 64) - 2, 0, 0, 0, 0, 0, 0),
            struct.pack("<B7xIIQB7x8Q", 7, 21, 22, 5, 9, *range(8)),
            struct.pack("<BB2xIIIQQ128s", 8, 2, 1, 2, 0, 5, 6, b"/bin/nc\0junk"),
            b"\x09" + bytes(300),
        ],
    )
    a = evlog.decode_socket(rows).first()
    assert (a.kind, a.pid, a.tgid, a.ret, a.latency_ns, a.ts_ns) == (2, 11, 12, -1, 5, 6)
    b = evlog.decode_times(rows).first()
    assert (b.dir, b.fd, b.ret, b.ts_ns) == ("R", -2, 3, 4)
    assert evlog.decode_handshake(rows).first().latency_ns == 77
    c = evlog.decode_stacks(rows).collect()
    assert [(x.tgid, x.pid, x.ips) for x in c] == [(21, 22, [1, -2])]
    assert [(x.op, x.path) for x in evlog.decode_file_ops(rows).collect()] == [(2, "/bin/nc")]
    assert evlog.decode_io(rows).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    records = slow_log(6) + [io("W", 7_000_000_000, ASK, fd=9), io("R", 7_100_000_000, SSE, fd=9), io("R", 7_200_000_000, b'{"usage":{"prompt_tokens":3}} [DONE]', fd=9)]
    decoded = evlog.decode_io(frame(spark, records))
    batch = sorted(map(tuple, replay.routed(decoded).collect()), key=repr)
    for part in range(3):  # each file is a micro-batch; halves of exchanges fall into different ones
        decoded.where(f"seq div 5 = {part}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
    stream = spark.readStream.schema(decoded.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = streaming.drain(streaming.routed(stream), "append", str(tmp_path / "ck"), "routed_rows")
    assert sorted(map(tuple, got.collect()), key=repr) == batch


def test_tick_rate_stream(spark, tmp_path):
    spark.createDataFrame([(k * 250_000_000,) for k in range(40)], "ts_ns long").coalesce(1).write.parquet(str(tmp_path / "in"))
    like = spark.read.parquet(str(tmp_path / "in"))
    got = streaming.drain(streaming.tick_rate(streaming.files(spark, str(tmp_path / "in"), like)), "complete", str(tmp_path / "ck"), "ticks")
    assert sorted(r.n for r in got.collect()) == [4] * 10


def test_session_and_policy_streams(spark, tmp_path):
    from wirelens.operators import policy

    spark.createDataFrame([(1, 3, 0), (1, 3, 10_000_000_000), (1, 3, 200_000_000_000)], "tgid long, fd int, ts_ns long").coalesce(1).write.parquet(str(tmp_path / "m"))
    m = streaming.files(spark, str(tmp_path / "m"), spark.read.parquet(str(tmp_path / "m")))
    got = streaming.drain(streaming.idle_sessions(m), "complete", str(tmp_path / "c1"), "sessions")
    assert sorted(r.n for r in got.collect()) == [1, 2]
    spark.createDataFrame([(1, 1, "/etc/ssh/key"), (2, 1, "/etc/sshd"), (3, 2, "/bin/nc")], "seq long, op int, path string").coalesce(1).write.parquet(str(tmp_path / "o"))
    o = streaming.files(spark, str(tmp_path / "o"), spark.read.parquet(str(tmp_path / "o")))
    rules = policy.rule_table(spark, "deny_open /etc/ssh\ndeny_exec nc\n")
    keep = lambda found: found.write.mode("append").parquet(str(tmp_path / "found"))
    streaming.policy_violations(o, rules, keep).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "found"))
    assert sorted((r.seq, r.rule) for r in got.collect()) == [(1, "deny_open /etc/ssh"), (3, "deny_exec nc")]


def test_late_rows_and_rolling_windows(spark, tmp_path):
    at = lambda seconds: [(s * 1_000_000_000,) for s in seconds]
    for part, seconds in enumerate(([0, 300], [301], [10, 270])):  # late rows are held against the batch before the last: 10 is behind 240
        spark.createDataFrame(at(seconds), "ts_ns long").coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
    stream = spark.readStream.schema("ts_ns long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = streaming.drain(streaming.tick_rate(stream), "update", str(tmp_path / "c1"), "late_ticks")
    assert sorted(r.s for r in got.selectExpr("unix_timestamp(tick) AS s").collect()) == [0, 270, 300, 301]

    x = [("GET", f"/u/{k}", "http", 500 if k == 0 else 200, 1000 + k, (30 + 40 * k) * 1_000_000_000) for k in range(3)]
    spark.createDataFrame(x, "method string, path string, protocol string, status int, latency_ns long, t_end_ns long").coalesce(1).write.parquet(str(tmp_path / "x"))
    ends = streaming.files(spark, str(tmp_path / "x"), spark.read.parquet(str(tmp_path / "x")))
    got = streaming.drain(streaming.rolling_endpoints(ends, "20 seconds", "60 seconds"), "complete", str(tmp_path / "c2"), "rolling")
    found = {r.s: (r.path, r.n, r.p50_ns, r.n_5xx) for r in got.selectExpr("unix_timestamp(window.start) AS s", "*").collect()}
    want = {s: [k for k in range(3) if s <= 30 + 40 * k < s + 60] for s in range(-20, 120, 20)}
    assert found == {s: ("/u/:id", len(ks), 1000 + ks[(len(ks) - 1) // 2], int(0 in ks)) for s, ks in want.items() if ks}


def test_stack_stream_of_a_log(spark, tmp_path):
    stacks = [struct.pack("<B7xIIQB7x8Q", 7, 21, 22, k, 2, k, k + 1, 0, 0, 0, 0, 0, 0) for k in range(1, 9)]
    path = str(tmp_path / "log")
    evlog.write_logs(frame(spark, stacks + slow_log(2)).select("rec").repartition(3), path)
    batch = evlog.decode_stacks(evlog.read_logs(spark, path)).select("ts_ns", "ips")
    stream = evlog.decode_stacks(evlog.read_logs(spark, path, stream=True)).select("ts_ns", "ips")
    got = streaming.drain(stream, "append", str(tmp_path / "ck"), "stack_rows")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) == [(k, [k, k + 1]) for k in range(1, 9)]
