"""Values at ranks of a whole table, without a total sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELLS = 1024


def value_at(values: DataFrame, q: float, name: str) -> DataFrame:
    """One row: the value at index min(n - 1, int(q n)) of values(v) sorted.

    Distinct values are counted, then the counts of value cells (at most CELLS of them) tell which cell holds the
    rank; only that cell's values are ordered.
    """
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    ends = counted.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"))
    width = F.greatest((F.col("hi") - F.col("lo")) / CELLS, F.lit(1e-300))
    placed = counted.crossJoin(F.broadcast(ends)).withColumn("cell", F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(CELLS - 1)))
    cells = placed.groupBy("cell", "n").agg(F.sum("c").alias("c"))
    run = cells.withColumn("upto", F.sum("c").over(Window.partitionBy("n").orderBy("cell")))
    index = F.least(F.col("n") - 1, F.floor(F.col("n") * q))
    chosen = run.where((F.col("upto") > index) & (F.col("upto") - F.col("c") <= index)).select("cell", (F.col("upto") - F.col("c")).alias("before"))
    inside = placed.join(F.broadcast(chosen), "cell")
    w = Window.partitionBy("cell").orderBy("v")
    ranked = inside.withColumn("end", F.col("before") + F.sum("c").over(w))
    return ranked.where((F.col("end") > index) & (F.col("end") - F.col("c") <= index)).select(F.col("v").alias(name))
