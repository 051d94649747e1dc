import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from wirelens.functions import scalars as S


def one(spark, column, **values):
    from pyspark.sql import types as T

    kinds = {str: T.StringType(), int: T.LongType(), bytes: T.BinaryType(), bool: T.BooleanType()}
    schema = T.StructType([T.StructField(k, kinds[type(v)]) for k, v in values.items()])
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(("ret", "size", "want"), [(8000, 20, 20), (512, 1 << 40, 256), (0, 100, 0), (-1, 100, 0), (100, 0, 0)])
def test_io_copy_len(spark, ret, size, want):
    assert one(spark, S.io_copy_len(F.col("r"), F.col("n")), r=ret, n=size) == want


@pytest.mark.parametrize(("text", "want"), [("GET / HTTP/1.1", True), ("POSTGRES", False), ("PRINTER", False), ("GET", False), ("HTTP/1.1 200", True), ("PRI * HTTP/2.0", True)])
def test_http_magic(spark, text, want):
    assert one(spark, S.http_magic(F.col("t")), t=text) is want


@pytest.mark.parametrize(("path", "want"), [("/users/123/posts/456", "/users/:id/posts/:id"), ("", "/"), ("/", "/"), ("/a1/2b", "/a1/2b"), ("/7", "/:id")])
def test_normalize_path(spark, path, want):
    assert one(spark, S.normalize_path(F.col("p")), p=path) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A: b\r\nAuthorization: Bearer secret\r\n\r\n", "A: b\r\nAuthorization: *************\r\n\r\n"),
        ("x-api-key:abc\r\nCOOKIE: a=1; b\r\nHost: h\r\n", "x-api-key:***\r\nCOOKIE: ******\r\nHost: h\r\n"),
        ("cookie: cookie: a\n", "cookie: *********\n"),
        ("nothing here", "nothing here"),
    ],
)
def test_redaction_keeps_length(spark, text, want):
    got = one(spark, S.redact_headers(F.col("t")), t=text)
    assert got == want
    assert len(got) == len(text)


def test_splitmix64_wraps_in_ansi_mode(spark):
    mask = (1 << 64) - 1

    def reference(x):
        x = (x + 0x9E3779B97F4A7C15) & mask
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    random.seed(4)
    values = [0, 1, -1, (1 << 63) - 1, -(1 << 63), *(random.randrange(-(1 << 63), 1 << 63) for _ in range(200))]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", S.splitmix64(F.col("v")).alias("h"), S.unsigned_mod(S.splitmix64(F.col("v")), 10).alias("m")).collect()
    for r in rows:
        want = reference(r.v & mask)
        assert r.h & mask == want
        assert r.m == want % 10


@pytest.mark.parametrize(
    ("path", "uid", "cid"),
    [
        ("/kubepods.slice/kubepods-podaaaaaaaa_bbbb_cccc_dddd_eeeeeeeeeeee.slice", "aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee", None),
        ("/kubepods/burstable/podaaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee/" + "f" * 64, "aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee", "f" * 64),
        ("/system.slice/docker-0123456789abcdef.scope", None, "0123456789abcdef"),
        ("/x/cri-containerd-0123456789ab.scope", None, "0123456789ab"),
        ("/user.slice", None, None),
    ],
)
def test_cgroup_paths(spark, path, uid, cid):
    assert one(spark, S.pod_uid(F.col("p")), p=path) == uid
    assert one(spark, S.container_id(F.col("p")), p=path) == cid


@pytest.mark.parametrize(("text", "want"), [('{"a":1,"input_tokens": 25}', 25), ('"input_tokens":x "input_tokens":3', None), ("none", None), ('"input_tokens" : 7,', 7)])
def test_number_after(spark, text, want):
    assert one(spark, S.number_after(F.col("t"), "input_tokens"), t=text) == want


def test_hdr_rounding_groups_three_digits(spark):
    got = [one(spark, S.hdr_rounded(F.col("v")), v=v) for v in (0, 5, 2047, 2048, 2049, 50_000_000)]
    assert got == [1, 5, 2047, 2049, 2049, 50_003_967]


def test_frame_header(spark):
    got = one(spark, S.frame_header(F.col("b")), b=bytes([0, 0, 5, 1, 4, 0x80, 0, 0, 3]))
    assert (got.length, got.type, got.flags, got.stream_id) == (5, 1, 4, 3)
    assert one(spark, S.frame_header(F.col("b")), b=b"short") is None


def test_labels_and_times(spark):
    assert one(spark, S.endpoint_label(F.lit("GET"), F.lit("/a"), F.col("p")), p="grpc") == "grpc GET /a"
    assert one(spark, S.fmt_ns(F.col("n")), n=2_500_000) == "2.50ms"
    assert one(spark, S.tcp_endpoint(F.col("a"), F.col("p"), F.lit(1)), a=int.from_bytes(bytes([10, 0, 0, 7]), "little"), p=int.from_bytes(bytes([1, 187]), "little")) == "10.0.0.7:443 connect"
    assert one(spark, S.is_sse(F.col("t")), t="HTTP/1.1 200 OK\r\nContent-Type: Text/Event-Stream\r\n\r\n") is True
    assert one(spark, S.span_otel_status(F.lit("grpc"), F.col("s")), s=200) == 2


def test_peers(spark):
    draw = random.Random(6)
    texts = ["::", "::1", "1::", "fe80::1", "1:0:0:2::3", "0:1::", "1:0:2:3:4:5:6:7", "10::20:0:0:1", "2001:db8::1:0:0:1", "::ffff:1.2.3.4"]
    texts += [ipaddress.IPv6Address(b"".join(draw.choice((b"\0\0", b"\0\0", b"\0\1", draw.randbytes(2))) for _ in range(8))).compressed for _ in range(200)]
    packed = [ipaddress.IPv6Address(t).packed for t in texts]
    rows = spark.createDataFrame([(k, 10, bytearray(p)) for k, p in enumerate(packed)] + [(-1, 2, bytearray([127, 0, 0, 1] + [0] * 12))], "k int, family int, address binary")
    got = {r.k: r.peer for r in rows.select("k", S.peer(F.col("family"), F.col("address"), F.lit(0x5000)).alias("peer")).collect()}
    mapped = lambda a: f"::ffff:{a.ipv4_mapped}" if a.ipv4_mapped else a.compressed
    assert got == {k: f"[{mapped(ipaddress.IPv6Address(p))}]:80" for k, p in enumerate(packed)} | {-1: "127.0.0.1:80"}
