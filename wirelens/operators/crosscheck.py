"""Spans held against a gateway's own record of the same calls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GREEDY = "row_id long, span_id long"


def comparable(steps: DataFrame, server: str = "") -> DataFrame:
    """Streamed steps without a fault that went well, of servers whose name has `server` in it."""
    good = steps.where("is_stream AND fault IS NULL AND outcome = 'ok'")
    return good.where(F.col("server").contains(server)) if server else good


def candidates(rows: DataFrame, spans: DataFrame, window: float, key: str | None = None) -> DataFrame:
    """row_id, span_id, total, gap of all pairs within the window of each other's end.

    rows: row_id, ts; spans: span_id, end, total (and a shared key column, if any). Ends are laid in cells of the
    window's size, so that the range is an equi-join on three neighbouring cells.
    """
    cell = lambda c: F.floor(F.col(c) / window)
    r = rows.withColumn("cell", F.explode(F.array(cell("ts") - 1, cell("ts"), cell("ts") + 1)))
    s = spans.withColumn("cell", cell("end"))
    on = ["cell"] + ([key] if key else [])
    gap = F.abs(F.col("end") - F.col("ts"))
    return r.join(s, on).where(gap <= window).select("row_id", "ts", "span_id", "total", gap.alias("gap"), *([key] if key else []))


def greedy(pairs: DataFrame, group: str, window: float) -> DataFrame:
    """One-to-one pairs: rows in time order take the longest free candidate, then the nearest.

    The order matters, so rows that can share spans are one fold in pandas. Rows whose times are more than two windows
    apart can't: a group is cut there, so that a busy one is many folds.
    """
    w = Window.partitionBy(group).orderBy("ts")
    far = F.col("ts") - F.lag("ts").over(w) > 2 * window * (1 + 1e-9)
    runs = pairs.withColumn("__far", F.coalesce(far, F.lit(False)).cast("long")).withColumn("__run", F.sum("__far").over(w))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for row_id, near in pdf.sort_values(["ts", "row_id"]).groupby("row_id", sort=False):
            free = near[~near["span_id"].isin(used)]
            if len(free):
                best = free.sort_values(["total", "gap", "span_id"], ascending=[False, True, True]).iloc[0]
                used.add(best["span_id"])
                out.append((row_id, best["span_id"]))
        return pd.DataFrame(out, columns=["row_id", "span_id"]).astype("int64")

    return runs.groupBy(group, "__run").applyInPandas(match, GREEDY)


def unmatched(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    return rows.join(pairs.select(key).distinct(), key, "left_anti")


def error_distribution(errors: DataFrame, value: str) -> DataFrame:
    """n, signed median, and p50, p90 (sorted[min(n - 1, int(q n))]) and max of the absolute errors.

    Values are counted first, and a running count finds each rank; nothing is gathered into one list.
    """
    from .ranks import value_at

    v = errors.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    a = v.select(F.abs("v").alias("v"))
    basic = v.agg(F.count(F.lit(1)).alias("n"), F.percentile("v", 0.5).alias("signed_median"), F.max(F.abs("v")).alias("max"))
    return basic.crossJoin(value_at(a, 0.5, "p50")).crossJoin(value_at(a, 0.9, "p90"))  # one row each


def zip_rows(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """The k-th row of each side within a key, side by side (right columns in r)."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    b = right.withColumn("__k", turn).select(F.col(key), "__k", F.struct(*[c for c in right.columns if c != key]).alias("r"))
    return left.withColumn("__k", turn).join(b, [key, "__k"]).drop("__k")


def read_steps(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """The gateway's steps: an export, or its database through JDBC. Who needs them in order of time sorts what is left."""
    return spark.read.format(fmt).options(**options).load(path)


def token_agreement(pairs: DataFrame, seen: str, true: str) -> DataFrame:
    same = F.col(seen).eqNullSafe(F.col(true))
    return pairs.agg(
        F.count_if(same).alias("exact"),
        F.count_if(F.col(seen).isNull()).alias("none"),
        F.count_if(F.col(seen).isNotNull() & ~same).alias("wrong"),
        F.count(F.lit(1)).alias("n"),
    )


def worst_relative_error(pairs: DataFrame, seen: str, true: str) -> DataFrame:
    return pairs.agg(F.max(F.abs(F.col(seen) - F.col(true)) / F.col(true)).alias("worst"))
