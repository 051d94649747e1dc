"""The replay query: log records to exchanges, model calls and a report.

The router is the one part that needs state per connection: model streams take reads first, then HTTP/2, then
header reassembly and request pairing. Its processor is a plain object, shared by batch (grouped by connection)
and streaming (kept state).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import scalars as S
from ..operators import aggregates
from ..operators.ordered import ordered_scan
from ..operators.h2 import PREFACE, Registry, frame, protocol_of, starts_connection
from ..sources import evlog

EXCHANGE = (
    "what string, tgid long, fd int, stream_id long, protocol string, method string, path string, status int, t_start_ns long, t_end_ns long,"
    " latency_ns long, is_client boolean, cgroup_id long, ttfb_ns long, input_tokens long, output_tokens long, complete boolean"
)
_COLUMNS = [f.split()[0] for f in EXCHANGE.replace(",", ", ").split(", ") if f.strip()]
_START = re.compile(rb"(?:GET|POST|PUT|HEAD|DELETE|OPTIONS|PATCH|PRI) |HTTP/")
_REQUEST = re.compile(rb"(?:GET|POST|PUT|HEAD|DELETE|OPTIONS|PATCH) ")
_LINE = re.compile(rb"([A-Z]+) ([^ \r\n]+)")
_STATUS = re.compile(rb"HTTP/1\.[01] ([0-9]{3})")
_SSE = re.compile(rb"(?i)\r\n[ \t]*content-type[ \t]*:[^\r\n]*text/event-stream")


_HEADER = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+:")
MAX_HEADERS = 32


def well_formed(text: bytes) -> bool:
    """Whether the whole header lines of a message are headers, and not too many; the captured text may end in any line."""
    lines = text.split(b"\r\n")[1:-1]
    if b"" in lines:
        lines = lines[: lines.index(b"")]
    return len(lines) <= MAX_HEADERS and all(map(_HEADER.match, lines))


def _number(text: bytes, key: bytes) -> int | None:
    at = text.find(b'"' + key + b'"')
    found = re.match(rb"\s*:\s*([0-9]{1,18})", text[at + len(key) + 2 :]) if at >= 0 else None
    return int(found[1]) if found else None


class Router:
    """The state of one connection (tgid, fd); feed() takes its records in order and returns finished rows."""

    def __init__(self, config: EngineConfig = DEFAULT):
        self.c = config
        self.h2 = Registry(config.pair_ttl_ns)
        self.buffers: dict[str, tuple[bytes, int, int]] = {}
        self.pending: tuple | None = None
        self.call: dict | None = None

    def feed(self, direction: str, ret: int, ts_ns: int, data: bytes, cgroup_id: int, client_only: bool) -> list[dict]:
        out: list[dict] = []
        if self.call is not None:
            if direction == "R":
                return self._chunk(data, ts_ns)
            out.append(self._finish())  # a write is the next request, which goes on below
        if ret < 0 or not data:
            return out
        is_http1 = not data.startswith(b"PRI ") and not (frame(data) and starts_connection(data)) and bool(_START.match(data))
        if self.h2.marked and is_http1:
            self.h2.drop()
        if self.h2.marked or starts_connection(data):
            for stream, method, path, status, t0, t1, began in self.h2.feed(direction, data, ts_ns, client_only):
                out.append(self._row("exchange", stream, protocol_of(path), method, path, status, t0, t1, began == "W", cgroup_id))
            return out
        message = self._assemble(direction, data, ts_ns)
        if message is not None:
            out += self._pair(direction, *message, cgroup_id, client_only)
        return out

    def end(self) -> list[dict]:
        return [self._finish()] if self.call is not None else []

    def _assemble(self, direction: str, data: bytes, ts_ns: int) -> tuple[bytes, int] | None:
        held = self.buffers.pop(direction, None)
        if held and ts_ns - held[2] > self.c.pair_ttl_ns:
            held = None
        if held:
            whole, first = (held[0] + data)[: self.c.message_cap], held[1]
        elif _START.match(data):
            whole, first = data[: self.c.message_cap], ts_ns
        else:
            return None
        if b"\r\n\r\n" not in whole and len(whole) < self.c.message_cap:
            self.buffers[direction] = (whole, first, ts_ns)
            return None
        return whole[: self.c.prefix_bytes], ts_ns if whole.startswith(b"HTTP/") else first

    def _pair(self, direction: str, text: bytes, ts_ns: int, cgroup_id: int, client_only: bool) -> list[dict]:
        waiting, self.pending = self.pending, None
        if waiting and text.startswith(b"HTTP/") and waiting[0] != direction and ts_ns - waiting[1] <= self.c.pair_ttl_ns:
            began, t0, request = waiting
            line, status = _LINE.match(request), _STATUS.match(text)
            out = []
            if line and status and well_formed(request) and well_formed(text):
                path = line[2].split(b"?")[0].decode("latin-1")
                out.append(self._row("exchange", 0, "http", line[1].decode(), path, int(status[1]), t0, ts_ns, began == "W", cgroup_id))
                if path in self.c.llm_paths and _SSE.search(text):
                    self.call = out[0] | {"what": "llm", "ttfb_ns": max(0, ts_ns - t0), "latency_ns": max(0, ts_ns - t0), "complete": False}
            return out
        if _REQUEST.match(text) and (direction == "W" or not client_only):
            self.pending = (direction, ts_ns, text)
        return []

    def _chunk(self, data: bytes, ts_ns: int) -> list[dict]:
        call = self.call
        call["t_end_ns"], call["latency_ns"] = ts_ns, max(0, ts_ns - call["t_start_ns"])
        for name, found in (
            ("input_tokens", next((v for k in (b"input_tokens", b"prompt_tokens") if (v := _number(data, k)) is not None), None)),
            ("output_tokens", _number(data, b"output_tokens") if b"message_delta" in data else None),
        ):
            if name == "output_tokens" and found is None:
                found = _number(data, b"completion_tokens")
            if found is not None:
                call[name] = found
        if b"message_stop" in data or b"[DONE]" in data:
            call["complete"] = True
            return [self._finish()]
        return []

    def _finish(self) -> dict:
        call, self.call = self.call, None
        return call

    def _row(self, what, stream, protocol, method, path, status, t0, t1, client, cgroup_id) -> dict:
        return dict.fromkeys(_COLUMNS) | {
            "what": what, "stream_id": stream, "protocol": protocol, "method": method, "path": path, "status": status, "t_start_ns": t0,
            "t_end_ns": t1, "latency_ns": max(0, t1 - t0), "is_client": client, "cgroup_id": cgroup_id,
        }


def rows_frame(rows: list[dict], tgid: int, fd: int) -> pd.DataFrame:
    out = pd.DataFrame([r | {"tgid": tgid, "fd": fd} for r in rows], columns=_COLUMNS)
    return out.astype({c: "Int64" for c in ("ttfb_ns", "input_tokens", "output_tokens")} | {"complete": "boolean"})


def routed(io: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Exchanges and model calls of decoded I/O rows (seq, kind, dir, fd, tgid, ret, ts_ns, cgroup_id, prefix).

    One shuffle on (tgid, fd); a task goes through its connections one after the other, row by row, so that no connection
    is gathered in memory. Model streams that are open at the end are given as incomplete.
    """
    order = [c for c in ("file", "seq") if c in io.columns]
    known = io.where("dir IS NOT NULL").withColumn("client_only", F.col("kind") == 4)
    rest = EXCHANGE.replace("tgid long, fd int, ", "")
    found = ordered_scan(known, ["tgid", "fd"], order, ["dir", "ret", "ts_ns", "prefix", "cgroup_id", "client_only"], rest, lambda: Router(config))
    return found.select(*_COLUMNS)


def replay(records: DataFrame, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(exchanges, model calls) of log records (seq, rec)."""
    rows = routed(evlog.decode_io(records), config)
    calls = rows.where("what = 'llm'").withColumnRenamed("latency_ns", "total_ns").withColumn("provider", S.llm_provider(F.col("path")))
    return rows.where("what = 'exchange'").drop("what", "ttfb_ns", "input_tokens", "output_tokens", "complete"), calls


def report(records: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Per label and status: count and middle latency."""
    return aggregates.replay_report(replay(records, config)[0])


def report_lines(records: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """part, line: the whole report as text: the number of records, a line for each label and status, one for each model call."""
    rows = routed(evlog.decode_io(records), config)
    some = lambda c: F.coalesce(F.concat(F.lit("Some("), F.col(c).cast("string"), F.lit(")")), F.lit("None"))
    total = records.agg(F.concat(F.lit("records="), F.count(F.lit(1)).cast("string")).alias("line"))
    counted = aggregates.replay_report(rows.where("what = 'exchange'"))
    shown = counted.select(F.concat_ws(" ", "label", "status", F.concat(F.lit("count="), "n"), F.concat(F.lit("p50_ns="), "p50_ns")).alias("line"))
    parts = ("path", "status", "ttfb_ns")
    calls = rows.where("what = 'llm'").select(
        F.concat_ws(
            " ", F.lit("llm"), *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in parts], F.concat(F.lit("total_ns="), F.col("latency_ns").cast("string")),
            F.concat(F.lit("in="), some("input_tokens")), F.concat(F.lit("out="), some("output_tokens")), F.concat(F.lit("complete="), F.col("complete").cast("string")),
        ).alias("line")
    )
    part = lambda n, df: df.select(F.lit(n).alias("part"), "line")
    return part(0, total).unionByName(part(1, shown)).unionByName(part(2, calls))


__all__ = ["PREFACE", "Router", "replay", "report", "report_lines", "routed"]
