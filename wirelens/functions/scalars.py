"""Column functions over wire records: classification, paths, labels, statuses, identifiers.

All are built-in expressions and stay inside code generation. Binary columns are read as ISO-8859-1 where a
function needs text, so that every byte is one character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Request methods, and the start of a response and of an HTTP/2 preface.
METHODS = ("GET", "POST", "PUT", "HEAD", "DELETE", "OPTIONS", "PATCH")
_REQUEST = "^(" + "|".join(METHODS) + ") "
_MAGIC = "^((" + "|".join((*METHODS, "PRI")) + ") |HTTP/)"


def latin1(b: Column) -> Column:
    return F.decode(b, "ISO-8859-1")


def http_magic(text: Column) -> Column:
    return F.coalesce(text.rlike(_MAGIC), F.lit(False))


def looks_like_request(text: Column) -> Column:
    return F.coalesce(text.rlike(_REQUEST), F.lit(False))


def looks_like_response(text: Column) -> Column:
    return F.coalesce(text.startswith("HTTP/"), F.lit(False))


def io_copy_len(ret: Column, buf_len: Column, prefix: int = 256) -> Column:
    return F.when((ret <= 0) | (buf_len == 0), F.lit(0)).otherwise(F.least(ret, buf_len, F.lit(prefix))).cast("int")


#: Kind and direction codes of records.
KINDS = {1: "connect", 2: "accept", 3: "sock_io", 4: "tls_io", 5: "sock_times", 6: "tls_handshake", 7: "stack", 8: "file_op"}
DIRECTIONS = {1: "R", 2: "W"}


def coded(value: Column, names: dict[int, str]) -> Column:
    """The name of a code; null for an unknown one."""
    out = F.lit(None).cast("string")
    for code, name in names.items():
        out = F.when(value == code, F.lit(name)).otherwise(out)
    return out


def is_syscall_error(ret: Column) -> Column:
    return ret < 0


def latency(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0))


def headers_done(text: Column) -> Column:
    return F.instr(text, "\r\n\r\n") > 0


def strip_query(path: Column) -> Column:
    return F.split_part(path, F.lit("?"), F.lit(1))


def normalize_path(path: Column) -> Column:
    """All-digit segments become :id; an empty path is /."""
    named = F.transform(F.split(path, "/"), lambda s: F.when(s.rlike("^[0-9]+$"), F.lit(":id")).otherwise(s))
    joined = F.array_join(named, "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def request_method(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^([A-Z]+) \S", 1), F.lit(""))


def request_path(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^[A-Z]+ ([^ \r\n]+)", 1), F.lit(""))


def response_status(text: Column) -> Column:
    """The status of an HTTP/1 response line, or null."""
    return F.nullif(F.regexp_extract(text, r"^HTTP/1\.[01] ([0-9]{3})", 1), F.lit("")).cast("int")


def status_code(text: Column) -> Column:
    """Leniently: the second word of the first 16 bytes as a number, else 0."""
    word = F.split_part(F.substring(text, 1, 16), F.lit(" "), F.lit(2))
    return F.when(word.rlike("^[0-9]{1,5}$"), word.cast("int")).otherwise(F.lit(0))


def endpoint_label(method: Column, path: Column, protocol: Column) -> Column:
    return F.when(protocol == "http", F.concat_ws(" ", method, path)).otherwise(F.concat_ws(" ", protocol, method, path))


def protocol_attr(protocol: Column) -> Column:
    return F.when(protocol == "http", F.lit("http/1.1")).otherwise(protocol)


def span_otel_status(protocol: Column, status: Column) -> Column:
    """2 (error) or 0 (unset); a gRPC status counts as an error unless it is 0."""
    bad = F.when(protocol == "grpc", status != 0).otherwise(status >= 500)
    return F.when(bad, F.lit(2)).otherwise(F.lit(0))


def status_class(status: Column) -> Column:
    hundreds = F.floor(status / 100)
    return F.when(hundreds.between(2, 5), F.concat(hundreds.cast("string"), F.lit("xx"))).otherwise(F.lit("other"))


def classify_protocol(path: Column) -> Column:
    """grpc for a path of package.Service/Method, else h2."""
    rest = F.regexp_replace(path, "^/", "")
    return F.when(rest.contains(".") & rest.contains("/"), F.lit("grpc")).otherwise(F.lit("h2"))


#: Headers whose values are secret.
SECRET_HEADERS = ("authorization", "cookie", "set-cookie", "api-key")


def redact_headers(text: Column) -> Column:
    """Every secret header's value, up to the end of its line, becomes as many asterisks.

    The text is cut where a secret header's name and colon end. Each piece after a cut begins with a value: its
    leading blanks stay, and the rest of its first line is starred.
    """
    names = "|".join(SECRET_HEADERS)
    marked = F.regexp_replace(text, rf"(?i)((?:{names}):[ \t]*)", "$1\u0001")
    # A name inside a value that is starred already has been marked too: its mark is starred away with the line.
    pieces = F.split(marked, "(?=[\r\n])")

    def line(piece: Column) -> Column:
        at = F.instr(piece, "\u0001")
        rest = F.replace(F.substring(piece, at + 1, F.length(piece)), F.lit("\u0001"), F.lit(""))
        return F.when(at == 0, piece).otherwise(F.concat(F.substring(piece, F.lit(1), at - 1), F.repeat(F.lit("*"), F.length(rest))))

    return F.array_join(F.transform(pieces, line), "")


def ipv4(daddr_be: Column) -> Column:
    """a.b.c.d of a network-order address that was read as a little-endian number."""
    part = lambda k: F.shiftrightunsigned(daddr_be.cast("long"), 8 * k).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", *[part(k) for k in range(4)])


def port(dport_be: Column) -> Column:
    value = dport_be.cast("int")
    return F.shiftleft(value.bitwiseAND(F.lit(255)), 8) + F.shiftright(value, 8).bitwiseAND(F.lit(255))


#: Address families.
IPV4, IPV6 = 2, 10


def ipv6(address: Column) -> Column:
    """Canonical text of 16 address bytes: the first longest run of zero groups is left out, mapped IPv4 is dotted."""
    digits = F.lower(F.hex(address))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.regexp_replace(digits.substr(k * 4 + 1, F.lit(4)), "^0{1,3}", ""))
    whole = F.array_join(groups, ":")
    shown = whole
    for n in range(2, 9):
        run = rf"(^|:)0(:0){{{n - 1}}}(:|$)"
        shown = F.when(whole.rlike(run), F.regexp_replace(whole, rf"^(.*?){run}(.*)$", "$1::$5")).otherwise(shown)
    quad = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(digits.substr(k * 2 + 25, F.lit(2)), 16, 10))
    return F.when(digits.startswith("0" * 20 + "ffff"), F.concat(F.lit("::ffff:"), F.array_join(quad, "."))).otherwise(shown)


def peer(family: Column, address: Column, dport_be: Column) -> Column:
    """a.b.c.d:port, or [v6]:port; IPv4 is the first four of the address bytes."""
    quad = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.hex(address).substr(k * 2 + 1, F.lit(2)), 16, 10))
    host = F.when(family == IPV6, F.concat(F.lit("["), ipv6(address), F.lit("]"))).otherwise(F.array_join(quad, "."))
    return F.concat(host, F.lit(":"), port(dport_be).cast("string"))


def tcp_endpoint(daddr_be: Column, dport_be: Column, kind: Column) -> Column:
    return F.concat(ipv4(daddr_be), F.lit(":"), port(dport_be).cast("string"), F.lit(" "), F.when(kind == 1, "connect").otherwise("accept"))


def dst_label(namespace: Column, name: Column, address: Column) -> Column:
    return F.coalesce(F.concat(namespace, F.lit("/"), name), address, F.lit("unknown"))


#: Bits of a peer entry: address known, sampling decided, keep.
HAS_ADDRESS, DECIDED, KEEP = 1, 2, 4


def merge_peer_flags(old: Column, new: Column) -> Column:
    """New peer data keeps the sampling decision of the old entry."""
    sampled = F.lit(DECIDED | KEEP)
    return new.bitwiseAND(F.bitwise_not(sampled)).bitwiseOR(F.coalesce(old, F.lit(0)).bitwiseAND(sampled))


def keep_from_flags(flags: Column) -> Column:
    """Undecided connections are kept."""
    return F.coalesce((flags.bitwiseAND(F.lit(DECIDED)) == 0) | (flags.bitwiseAND(F.lit(KEEP)) != 0), F.lit(True))


def frame_header(b: Column) -> Column:
    """Length, type, flags and stream of an HTTP/2 frame header; null if there are fewer than 9 bytes."""
    number = lambda at, n: F.conv(F.hex(F.substring(b, at, n)), 16, 10).cast("long")
    fields = F.struct(
        number(1, 3).alias("length"),
        number(4, 1).cast("int").alias("type"),
        number(5, 1).cast("int").alias("flags"),
        number(6, 4).bitwiseAND(F.lit(0x7FFFFFFF)).alias("stream_id"),
    )
    return F.when(F.length(b) >= 9, fields)


def header_value(text: Column, name: str) -> Column:
    """The trimmed value of a header, null if absent; the first line is no header."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)\r\n[ \t]*{name}[ \t]*:([^\r\n]*)"), F.lit(1))
    return F.trim(F.try_element_at(found, F.lit(1)))


def is_sse(text: Column) -> Column:
    return F.coalesce(F.lower(header_value(text, "content-type")).contains("text/event-stream"), F.lit(False))


def number_after(text: Column, key: str) -> Column:
    """The unsigned number after the first "key" and its colon; null if no number follows that first one."""
    rest = F.when(F.instr(text, f'"{key}"') > 0, F.substring_index(text, f'"{key}"', -1))
    first = F.substring(text, F.instr(text, f'"{key}"') + len(key) + 2, F.length(text))
    return F.when(rest.isNotNull(), F.nullif(F.regexp_extract(first, r"^\s*:\s*([0-9]{1,18})", 1), F.lit(""))).cast("long")


def llm_provider(path: Column) -> Column:
    return F.when(path.startswith("/v1/messages"), F.lit("anthropic")).otherwise(F.lit("openai"))


_UID = "[0-9A-Fa-f]{8}[-_][0-9A-Fa-f]{4}[-_][0-9A-Fa-f]{4}[-_][0-9A-Fa-f]{4}[-_][0-9A-Fa-f]{12}"


def pod_uid(cgroup_path: Column) -> Column:
    """The pod uid of a cgroup path: a systemd slice or a pod<uid> folder."""
    found = F.regexp_extract(cgroup_path, rf"(?:^|/)(?:kubepods(?:-guaranteed|-burstable|-besteffort)?-)?pod({_UID})(?:\.slice)?(?:/|$)", 1)
    return F.translate(F.nullif(found, F.lit("")), "_", "-")


def container_id(cgroup_path: Column) -> Column:
    found = F.regexp_extract_all(
        cgroup_path, F.lit(r"(?:^|/)(?:(?:cri-containerd|docker)-([0-9A-Fa-f]{12,})(?:\.scope)?|([0-9A-Fa-f]{64}))(?=/|$)"), F.lit(0)
    )
    first = F.try_element_at(found, F.lit(1))
    return F.regexp_replace(F.regexp_replace(first, "^/?(cri-containerd-|docker-)?", ""), r"\.scope$", "")


def process_label(uid: Column, cid: Column, comm: Column, tgid: Column) -> Column:
    name = F.coalesce(F.nullif(F.trim(comm), F.lit("")), F.lit("unknown"))
    return F.coalesce(
        F.concat(F.lit("pod:"), F.substring(uid, 1, 8)),
        F.concat(F.lit("ctr:"), F.substring(cid, 1, 12)),
        F.concat(F.lit("proc:"), name, F.lit(":"), tgid.cast("string")),
    )


def process_name(comm: Column, argv0: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(comm), F.lit("")), F.element_at(F.split(argv0, "/"), -1))


def is_otlp_export_route(method: Column, path: Column) -> Column:
    return (F.upper(method) == "POST") & F.regexp_replace(path, "/+$", "").isin("/v1/traces", "/v1/metrics", "/v1/logs")


def hdr_rounded(v: Column) -> Column:
    """The largest value that a histogram with three significant digits can't tell from v (at least 1)."""
    x = F.greatest(v, F.lit(1))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(x)) - 11, F.lit(0)))
    return F.when(x < 2048, x).otherwise(x - x % unit + unit - 1).cast("long")


def _hi_lo_product(a: Column, b: int) -> Column:
    """a * b modulo 2^64 on signed longs, without overflow: 32-bit halves through 16-bit steps."""
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    a_low, a_high = low(a), F.shiftrightunsigned(a, 32)
    b_low, b_high = b & 0xFFFFFFFF, b >> 32
    # a_low * b_low in two steps of 16 bits, so that no product reaches 2^63.
    p0 = a_low * F.lit(b_low & 0xFFFF)
    p1 = a_low * F.lit(b_low >> 16)
    cross = low(a_low * F.lit(b_high & 0xFFFF)) + F.shiftleft(low(a_low * F.lit(b_high >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    cross = cross + low(a_high * F.lit(b_low & 0xFFFF)) + F.shiftleft(low(a_high * F.lit(b_low >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    middle = p1 + F.shiftrightunsigned(p0, 16)
    low_word = F.shiftleft(middle.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(p0.bitwiseAND(F.lit(0xFFFF)))
    high_word = low(F.shiftrightunsigned(middle, 16) + cross)
    return F.shiftleft(high_word, 32).bitwiseOR(low(low_word))


def _wrapped_sum(a: Column, b: int) -> Column:
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    bottom = low(a) + F.lit(b & 0xFFFFFFFF)
    top = low(F.shiftrightunsigned(a, 32) + F.lit(b >> 32) + F.shiftrightunsigned(bottom, 32))
    return F.shiftleft(top, 32).bitwiseOR(low(bottom))


def splitmix64_steps() -> tuple:
    """The stages of splitmix64 as column functions; each is one projection (see splitmix64)."""
    # The generator's constants.
    return (
        lambda x: _wrapped_sum(x, 0x9E3779B97F4A7C15),
        lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, 30)),
        lambda z: _hi_lo_product(z, 0xBF58476D1CE4E5B9),
        lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, 27)),
        lambda z: _hi_lo_product(z, 0x94D049BB133111EB),
        lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, 31)),
    )


def splitmix64(x: Column) -> Column:
    """splitmix64 of a long, with 64-bit wrapping, whether or not ANSI mode is on.

    Each stage is bound by a one-element array, so that no stage is written out more than once.
    """
    value = F.array(x)
    for step in splitmix64_steps():
        value = F.transform(value, step)
    return F.element_at(value, 1)


def mix64(tgid: Column, fd: Column, stream_id: Column, t_start_ns: Column) -> Column:
    mixed = t_start_ns.bitwiseXOR(F.shiftleft(tgid.cast("long"), 32)).bitwiseXOR(fd.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    return splitmix64(mixed.bitwiseXOR(F.shiftleft(stream_id.cast("long"), 17)))


def unsigned_mod(h: Column, n: int) -> Column:
    return F.pmod(F.pmod(F.shiftrightunsigned(h, 1), F.lit(n)) * 2 + h.bitwiseAND(F.lit(1)), F.lit(n))


def hex64(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def fmt_ns(ns: Column) -> Column:
    return (
        F.when(ns >= 1_000_000, F.format_string("%.2fms", ns / 1e6)).when(ns >= 1_000, F.format_string("%.1fµs", ns / 1e3)).otherwise(F.concat(ns.cast("string"), F.lit("ns")))
    )


def truncate_symbol(name: Column, limit: int = 120) -> Column:
    return F.when(F.length(name) > limit, F.concat(F.substring(name, 1, limit), F.lit("…"))).otherwise(name)


def c_string(b: Column) -> Column:
    """Text up to the first NUL of a binary path."""
    return F.split_part(F.make_valid_utf8(b.cast("string")), F.lit("\0"), F.lit(1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def unix_range(latency_ns: Column, now_unix_ns: Column) -> Column:
    """Start and end of an ordinary span that ends now."""
    return F.struct(F.greatest(now_unix_ns - latency_ns, F.lit(0)).alias("start_ns"), now_unix_ns.alias("end_ns"))


def unix_range_of_call(start_mono_ns: Column, total_ns: Column, now_mono_ns: Column, now_unix_ns: Column) -> Column:
    """Start and end of a model call, which ended some monotonic time ago."""
    end = now_unix_ns - F.greatest(now_mono_ns - (start_mono_ns + total_ns), F.lit(0))
    return F.struct(F.greatest(end - total_ns, F.lit(0)).alias("start_ns"), end.alias("end_ns"))
