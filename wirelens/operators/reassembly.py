"""Headers that come in several reads or writes, put together."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from .ordered import ordered_scan

_START = re.compile(r"(?:GET|POST|PUT|HEAD|DELETE|OPTIONS|PATCH|PRI) |HTTP/")


class _Buffer:
    """The message that one direction of a connection is in."""

    def __init__(self, ttl_ns: int, cap: int, prefix: int):
        self.ttl, self.cap, self.prefix, self.parts = ttl_ns, cap, prefix, None

    def feed(self, seq, ts_ns, text, kind, pid, cgroup_id) -> list[dict]:
        if self.parts is not None and ts_ns - self.at > self.ttl:
            self.parts = None
        if self.parts is not None:
            held = self.parts[-3:]  # the blank line may be cut in two
            self.parts = (self.parts + text)[: self.cap]
        elif _START.match(text):
            held, self.parts, self.first, self.kind, self.pid = "", text[: self.cap], ts_ns, kind, pid
        else:
            return []
        self.at = ts_ns
        if "\r\n\r\n" not in held + text and len(self.parts) < self.cap:
            return []
        whole, self.parts = self.parts, None
        when = ts_ns if whole.startswith("HTTP/") else self.first
        return [{"seq": seq, "ts_ns": when, "text": whole[: self.prefix], "kind": self.kind, "pid": self.pid, "cgroup_id": cgroup_id}]

    def end(self) -> list[dict]:
        return []


def reassemble(chunks: DataFrame, ttl_ns: int = DEFAULT.pair_ttl_ns, cap: int = DEFAULT.message_cap, prefix: int = DEFAULT.prefix_bytes) -> DataFrame:
    """Messages: tgid, fd, dir, seq (of the last chunk), ts_ns, text (at most `prefix` characters), kind, pid, cgroup_id.

    chunks: tgid, fd, dir, seq, ts_ns, text (ISO-8859-1 of the bytes), kind, pid, cgroup_id. A message starts at a chunk
    with HTTP magic, takes in the next chunks of its direction, and ends at the blank line or at `cap` characters.
    One that waits longer than the TTL is forgotten. A request's time is its first chunk's, a response's its last.
    """
    plain = chunks.where("length(text) > 0").select(
        "tgid", "fd", "dir", F.col("seq").cast("long").alias("seq"), F.col("ts_ns").cast("long").alias("ts_ns"), "text", F.col("kind").cast("int").alias("kind"),
        F.col("pid").cast("long").alias("pid"), F.col("cgroup_id").cast("long").alias("cgroup_id"),
    )
    schema = "seq long, ts_ns long, text string, kind int, pid long, cgroup_id long"
    return ordered_scan(plain, ["tgid", "fd", "dir"], ["seq"], ["seq", "ts_ns", "text", "kind", "pid", "cgroup_id"], schema, lambda: _Buffer(ttl_ns, cap, prefix))
