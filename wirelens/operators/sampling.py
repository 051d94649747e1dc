"""Controllers and queues that depend on order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT
from .ordered import ordered_scan


class _Controller:
    """A tick with drops doubles n (up to n_max); `decay` quiet ticks halve it (down to 1)."""

    def __init__(self, n_max: int, decay: int):
        self.n_max, self.decay, self.n, self.quiet = n_max, decay, 1, 0

    def feed(self, tick: int, drops: int) -> list[dict]:
        self.quiet = 0 if drops else self.quiet + 1
        if drops:
            self.n = min(self.n_max, 2 * self.n)
        elif self.quiet >= self.decay:
            self.n, self.quiet = max(1, self.n // 2), 0
        return [{"tick": tick, "n": self.n}]

    def end(self) -> list[dict]:
        return []


def sample_controller(ticks: DataFrame, n_max: int = DEFAULT.sample_n_max, decay: int = DEFAULT.sample_decay_ticks) -> DataFrame:
    """node, tick, n: the sampling divisor after each tick. ticks: node, tick, drops (new drops in the tick)."""
    plain = ticks.select("node", F.col("tick").cast("long").alias("tick"), F.coalesce("drops", F.lit(0)).cast("long").alias("drops"))
    return ordered_scan(plain, ["node"], ["tick"], ["tick", "drops"], "tick long, n long", lambda: _Controller(n_max, decay))


def span_queue(spans: DataFrame, flush_ns: int, cap: int = DEFAULT.span_queue) -> DataFrame:
    """spans(seq, node, ts_ns) with kept: a queue takes the first cap spans between two flushes and drops the rest."""
    flush = F.floor(F.col("ts_ns") / flush_ns)
    turn = F.row_number().over(Window.partitionBy("node", flush).orderBy("ts_ns", "seq"))
    return spans.withColumn("kept", turn <= cap)
