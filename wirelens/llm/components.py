"""Connected components of a distributed list of links, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work


def _roots(hooks: DataFrame, work: Work) -> DataFrame:
    """hooks (node, comp: its parent) with the root of each node's tree as comp, by pointer jumping."""
    while True:
        up = hooks.select(F.col("node").alias("up_node"), F.col("comp").alias("up"))
        jumped = hooks.join(up, F.col("comp") == F.col("up_node"), "left").select("node", F.coalesce("up", "comp").alias("comp"), F.col("up").isNotNull().alias("moved"))
        after = work.save(jumped, "roots")
        work.drop(hooks)
        if not after.where("moved").limit(1).count():
            return after
        hooks = after


def relabelled(rows: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """rows with `column` replaced by its node's component in moves (node, comp), where it has one."""
    up = moves.select(F.col("node").alias("__node"), F.col("comp").alias("__comp"))
    return rows.join(up, F.col(column) == F.col("__node"), "left").withColumn(column, F.coalesce("__comp", column)).drop("__node", "__comp")


def components(links: DataFrame, work: Work) -> DataFrame:
    """node, comp for the nodes of links (a, b: bigint) but one of each component, its root, which is their comp.

    In each round every node hooks itself to its neighbour of the highest degree (the smaller number among equals) if that
    ranks above itself. So a node that has links and stays a root ranks above all its neighbours, and at least half of
    the nodes hook: their number halves in every round, and a star goes in one. Then the links are contracted: ends are
    replaced by roots, equal ones and repeated links go. No step makes more rows than twice the links.
    """
    moves = None
    left = work.save(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        if not left.limit(1).count():
            return left.select(F.col("a").alias("node"), F.col("b").alias("comp")) if moves is None else moves
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        # Written before it is joined: the plain exchanges that the joins then have can be split where a node is hot.
        degrees = work.save(ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "degrees")
        rank = lambda degree, node: F.struct(F.col(degree).alias("degree"), (-F.col(node)).alias("back"))
        far = degrees.select(F.col("node").alias("other"), F.col("degree").alias("far"))
        best = work.save(ends.join(far, "other").groupBy("node").agg(F.max(rank("far", "other")).alias("best")), "best")
        hooks = best.join(degrees, "node").where(F.col("best") > rank("degree", "node")).select("node", (-F.col("best.back")).alias("comp"))
        roots = _roots(work.save(hooks, "hooks"), work)
        after = roots.select("node", "comp")
        if moves is not None:
            after = relabelled(moves, "comp", roots).unionByName(after)
        after = work.save(after, "moves")
        ends_moved = relabelled(relabelled(left, "a", roots), "b", roots).where("a <> b")
        rest = work.save(ends_moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        work.drop(left, degrees, best, roots, *([moves] if moves is not None else []))
        moves, left = after, rest
