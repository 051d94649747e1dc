"""The dashboard's range queries over metric points, as DataFrame plans.

points: series columns, ts_ns, value; a counter may reset. A rate over a window is the increase between the first
and last point in it, with resets added back, extended towards the window's ends as the query language defines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SECOND


def increase(points: DataFrame, series: list[str], at_ns: Column, window_ns: int) -> DataFrame:
    """series, increase over (at - window, at]; series with fewer than two points there have none."""
    inside = points.withColumn("__at", at_ns).where((F.col("ts_ns") > F.col("__at") - window_ns) & (F.col("ts_ns") <= F.col("__at")))
    w = Window.partitionBy(*series).orderBy("ts_ns")
    before = F.lag("value").over(w)
    step = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    got = (
        inside.withColumn("__step", step)
        .groupBy(*series)
        .agg(
            F.sum("__step").alias("raw"),
            F.count(F.lit(1)).alias("n"),
            F.min("ts_ns").alias("first"),
            F.max("ts_ns").alias("last"),
            F.min_by("value", "ts_ns").alias("v0"),
            F.max("__at").alias("at"),
        )
        .where("n >= 2 AND last > first")
    )
    span = F.col("last") - F.col("first")
    gap = span / (F.col("n") - 1)
    reach = lambda room: F.when(room < gap * 1.1, room).otherwise(gap / 2)
    # A counter can't have been below 0 before its first point.
    to_zero = F.when((F.col("raw") > 0) & (F.col("v0") >= 0), span * (F.col("v0") / F.col("raw")))
    start = F.least(reach(F.col("first") - (F.col("at") - window_ns)), F.coalesce(to_zero, F.lit(float("inf"))))
    whole = span + start + reach(F.col("at") - F.col("last"))
    return got.select(*series, (F.col("raw") * (whole / span)).alias("increase"))


def rate(points: DataFrame, series: list[str], at_ns: Column, window_ns: int) -> DataFrame:
    return increase(points, series, at_ns, window_ns).select(*series, (F.col("increase") / (window_ns / SECOND)).alias("rate"))


def summed(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias(value))


def latest(points: DataFrame, series: list[str]) -> DataFrame:
    return points.groupBy(*series).agg(F.max_by("value", "ts_ns").alias("value"))


def cumulative_buckets(rows: DataFrame, by: list[str], bounds: tuple[int, ...]) -> DataFrame:
    """by, le, value: cumulative counts from rows with per-bucket counts (buckets)."""
    le = F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))
    sums = rows.select(*by, F.posexplode("buckets").alias("i", "c")).groupBy(*by, "i").agg(F.sum("c").alias("c"))
    running = F.sum("c").over(Window.partitionBy(*by).orderBy("i"))
    return sums.select(*by, F.element_at(le, F.col("i") + 1).alias("le"), running.cast("double").alias("value"))


def rate_quantile(q: float, points: DataFrame, series: list[str], by: list[str], at_ns: Column, window_ns: int) -> DataFrame:
    """by, quantile: of the summed rates of bucket counters (series, le, ts_ns, value) over a window."""
    rates = summed(rate(points, [*series, "le"], at_ns, window_ns), "rate", [*by, "le"])
    return histogram_quantile(q, rates.withColumnRenamed("rate", "value"), by)


def histogram_quantile(q: float, buckets: DataFrame, by: list[str]) -> DataFrame:
    """by, quantile: linear within the bucket that holds rank q of the total; the last finite bound beyond it.

    buckets: by, le (inf for the last), value (cumulative).
    """
    w = Window.partitionBy(*by).orderBy("le")
    total = F.max("value").over(Window.partitionBy(*by))
    # Rates of neighbouring buckets may fall a little; a cumulative count can't.
    rows = (
        buckets.withColumn("value", F.max("value").over(w))
        .withColumn("total", total)
        .withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
        .withColumn("below", F.coalesce(F.lag("value").over(w), F.lit(0.0)))
        .where("total > 0")
    )
    rank = F.col("total") * q
    first = rows.where(F.col("value") >= rank).groupBy(*by).agg(F.min(F.struct("le", "low", "below", "value", "total")).alias("b"))
    inner = F.col("b.low") + (F.col("b.le") - F.col("b.low")) * F.try_divide(F.col("b.total") * q - F.col("b.below"), F.col("b.value") - F.col("b.below"))
    return first.select(*by, F.when(F.col("b.le") == float("inf"), F.col("b.low")).otherwise(F.coalesce(inner, "b.le")).alias("quantile"))


#: How a metric's name and unit read in the exposition.
def exposition_name(name: Column, kind: Column, unit: Column) -> Column:
    base = F.translate(name, ".", "_")
    with_unit = F.when(unit == "ms", F.concat(base, F.lit("_milliseconds"))).otherwise(base)
    return F.when(kind == "sum", F.concat(with_unit, F.lit("_total"))).when(kind == "histogram", F.concat(with_unit, F.lit("_bucket"))).otherwise(with_unit)
