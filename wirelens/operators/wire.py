"""Side streams joined to exchanges: wire times, handshakes, CPU stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT


def dual_plane(x: DataFrame, times: DataFrame, window_ns: int = DEFAULT.join_window_ns, slack_ns: int = DEFAULT.wire_slack_ns) -> DataFrame:
    """x with wire_ns and outcome: hit, fallback or miss.

    x: xid, tgid, fd, t0, t1, start_dir, end_dir; times: tgid, fd, ts_ns, dir. The start is the latest time in
    [t0 - W, t0]; the end the latest in [t1 - W, t1] (hit), else in [t1 + 1, t1 + W] (fallback). A wire time must be
    positive and at most the content's time plus the slack. Times are laid in cells of W nanoseconds and each exchange
    looks into the few cells that its two stretches touch: an equi-join on (tgid, fd, cell), whose cost doesn't grow
    with a connection's length.
    """
    w = max(window_ns, 1)
    cell = lambda c: F.floor(c / w)
    near = F.array_distinct(F.concat(F.sequence(cell(F.col("t0") - window_ns), cell(F.col("t0"))), F.sequence(cell(F.col("t1") - window_ns), cell(F.col("t1") + window_ns))))
    probes = x.select("xid", "tgid", "fd", "t0", "t1", "start_dir", "end_dir", F.explode(near).alias("cell"))
    n = times.select("tgid", "fd", F.col("ts_ns").alias("n_ts"), F.col("dir").alias("n_dir"), cell(F.col("ts_ns")).alias("cell"))
    t, d = F.col("n_ts"), F.col("n_dir")
    best = (
        probes.join(n, ["tgid", "fd", "cell"])
        .groupBy("xid")
        .agg(
            F.max(F.when((d == F.col("start_dir")) & t.between(F.col("t0") - window_ns, F.col("t0")), t)).alias("s"),
            F.max(F.when((d == F.col("end_dir")) & t.between(F.col("t1") - window_ns, F.col("t1")), t)).alias("e"),
            F.max(F.when((d == F.col("end_dir")) & t.between(F.col("t1") + 1, F.col("t1") + window_ns), t)).alias("f"),
        )
    )
    content = F.greatest(F.col("t1") - F.col("t0"), F.lit(0))
    good = lambda end: F.coalesce((end - F.col("s") > 0) & (end - F.col("s") <= content + slack_ns), F.lit(False))
    hit, late = good(F.col("e")), good(F.col("f"))
    return (
        x.join(best, "xid", "left")
        .withColumn("wire_ns", F.when(hit, F.col("e") - F.col("s")).when(late, F.col("f") - F.col("s")))
        .withColumn("outcome", F.when(hit, F.lit("hit")).when(late, F.lit("fallback")).otherwise(F.lit("miss")))
        .drop("s", "e", "f")
    )


def join_outcomes(joined: DataFrame) -> DataFrame:
    """attempts, hits, fallbacks, misses and hit_rate (0 without attempts; a fallback is no hit)."""
    n = lambda what: F.count_if(F.col("outcome") == what)
    return joined.agg(
        F.count(F.lit(1)).alias("attempts"),
        n("hit").alias("hits"),
        n("fallback").alias("fallbacks"),
        n("miss").alias("misses"),
        F.coalesce(F.try_divide(n("hit"), F.count(F.lit(1))), F.lit(0.0)).alias("hit_rate"),
    )


def handshake_once(spans: DataFrame, handshakes: DataFrame, ttl_ns: int = DEFAULT.pair_ttl_ns) -> DataFrame:
    """spans(seq, tgid, fd, t_start_ns, t_end_ns) with handshake_ns, which the first span to ask for it consumes.

    A span asks for the latest handshake that was seen up to its end; one that began after the span did, or is
    older than the TTL, gives nothing. handshakes: hs_id, tgid, fd, ts_ns, latency_ns.
    """
    rows = spans.select(
        "tgid", "fd", F.col("t_end_ns").alias("at"), F.lit(1).alias("side"), "seq", "t_start_ns", F.lit(None).cast("struct<id:bigint,ts:bigint,ns:bigint>").alias("h")
    ).unionByName(
        handshakes.select(
            "tgid",
            "fd",
            F.col("ts_ns").alias("at"),
            F.lit(0).alias("side"),
            F.lit(None).cast("long").alias("seq"),
            F.lit(None).cast("long").alias("t_start_ns"),
            F.struct(F.col("hs_id").alias("id"), F.col("ts_ns").alias("ts"), F.col("latency_ns").alias("ns")).alias("h"),
        )
    )
    w = Window.partitionBy("tgid", "fd").orderBy("at", "side", F.coalesce("seq", "h.id")).rowsBetween(Window.unboundedPreceding, 0)
    asked = rows.withColumn("l", F.last("h", True).over(w)).where("side = 1")
    usable = asked.withColumn("ok", F.coalesce((F.col("l.ts") <= F.col("t_start_ns")) & (F.col("at") - F.col("l.ts") <= ttl_ns), F.lit(False)))
    turn = F.row_number().over(Window.partitionBy("tgid", "fd", "l.id", "ok").orderBy("at", "seq"))
    return usable.withColumn("turn", turn).select("seq", F.when(F.col("ok") & (F.col("turn") == 1), F.col("l.ns")).alias("handshake_ns"))


def top_frames(spans: DataFrame, stacks: DataFrame, top: int = DEFAULT.profile_top, ttl_ns: int = DEFAULT.profile_ttl_ns, min_ns: int = DEFAULT.profile_min_ns) -> DataFrame:
    """span, rank, frame, n: the most frequent frames of the stacks that were sampled during a span.

    spans: span, tgid, t0, t1; stacks: tgid, ts_ns, frames. Only spans of min_ns or more, and samples at most ttl_ns
    before the span's end. Equi-join on (tgid, cell of ttl_ns): a span looks into two cells.
    """
    long_spans = spans.where(F.col("t1") - F.col("t0") >= min_ns)
    low = F.greatest(F.col("t0"), F.col("t1") - ttl_ns)
    probes = long_spans.withColumn("cell", F.explode(F.sequence(F.floor(low / ttl_ns), F.floor(F.col("t1") / ttl_ns))))
    samples = stacks.withColumn("cell", F.floor(F.col("ts_ns") / ttl_ns))
    counted = (
        probes.join(samples, ["tgid", "cell"])
        .where(F.col("ts_ns").between(low, F.col("t1")))
        .select("span", F.explode("frames").alias("frame"))
        .groupBy("span", "frame")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("span").orderBy(F.desc("n"), "frame"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top)


def symbolized(stacks: DataFrame, symbols: DataFrame, cell: int = 4096) -> DataFrame:
    """stacks(tgid, seq, ips) with frames: names of symbols(tgid, lo, hi, name), hex where none covers; 0 is dropped."""
    ips = stacks.select("tgid", "seq", F.posexplode("ips").alias("pos", "ip")).where("ip <> 0").withColumn("cell", F.floor(F.col("ip") / cell))
    ranges = symbols.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    named = ips.alias("i").join(
        ranges.alias("r"),
        (F.col("i.tgid") == F.col("r.tgid")) & (F.col("i.cell") == F.col("r.cell")) & (F.col("ip") >= F.col("lo")) & (F.col("ip") < F.col("hi")),
        "left",
    )
    name = F.coalesce("name", F.concat(F.lit("0x"), F.lower(F.hex("ip"))))
    return (
        named.select("i.tgid", "seq", "pos", name.alias("frame"))
        .groupBy("tgid", "seq")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "frame"))), lambda s: s["frame"]).alias("frames"))
    )
