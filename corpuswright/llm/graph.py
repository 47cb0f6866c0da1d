"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables


def _tied(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with m of least (u, m, n). A hub's rows are dealt out by v: see tables.looked_up."""
    return tables.looked_up(rows, least, ["u"], "n", total, ["v"])


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node ties its larger neighbours to the least of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _tied(both.where("v > u"), least, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node ties its smaller neighbours and itself to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    tied = _tied(edges, least, total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """edges: a, b (long). Returns node, component (the least node reachable), written; nodes without an edge don't appear.

    A hub's edges are never gathered: its least neighbour is a partial aggregate and reaches its rows by
    broadcast. An empty table gives an empty one; loops and repeated edges do no harm. Raises if
    most_rounds don't suffice (their number grows with the logarithm of the nodes)."""
    now = tables.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    total = now.count()  # later rounds have two rows at most for each of these
    for _ in range(most_rounds):
        large = tables.written(_large_star(now, total), "large")
        after = tables.written(_small_star(large, total), "edges")
        tables.drop(now, large)
        now = after
        # Where no node points twice, or both points and is pointed at, all edges are stars around their least node.
        ends = F.array(*[F.struct(F.col(c).alias("node"), F.lit(n).alias("up"), F.lit(1 - n).alias("down")) for c, n in (("u", 1), ("v", 0))])
        open_ = now.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        if open_.where("up + down > 1").isEmpty():
            heads = now.select(F.col("v").alias("node")).distinct()
            out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads.select("node", F.col("node").alias("component")))
            out = tables.written(out, "components")
            tables.drop(now)
            return out
    raise RuntimeError("components have not settled")
