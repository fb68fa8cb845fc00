"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sieve


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: of each node, hang its larger neighbours on the least of it and all its neighbours; small: hang it and its smaller ones."""
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    hung = both.join(least, "a")
    if large:
        out = hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable), one row for each node that has an edge to another.

    Steps repeat until the edges are stars, O(log^2 n) at most; each round is written to the shared folder. Loops, repeated edges and
    nulls are dropped; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    e = cut(e.filter("a > b").distinct(), "edges")
    mark = None
    while True:
        row = e.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).head()
        if (row["n"], row["x"]) == mark:
            break
        mark = (row["n"], row["x"])
        if not row["n"]:
            break
        e = cut(_star(_star(e, True), False), "edges")
    # at the fixed point each node has one edge, to the least node of its component
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def least_of(edges: DataFrame, who: DataFrame, node: str) -> DataFrame:
    """node, who: of each node with an edge to another, the least ``who`` of its component. who: node, who for every node; nulls are no one's."""
    found = components(edges).select(F.col("node").alias(node), "component")
    least = found.join(who.select(node, "who"), node).groupBy("component").agg(F.min("who").alias("who"))
    return found.join(least, "component").select(node, "who")


def edges_of_ids(rows: DataFrame, id_col: str, node: str) -> DataFrame | None:
    """a, b: for ids that stand at several nodes, from each of them to one. None where there is no such id, which is the rule. Null ids have none."""
    several = rows.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(node).alias("a"), F.max(node).alias("_b")).filter("a < _b").select(id_col, "a")
    several = cut(several, "several")
    if several.isEmpty():
        return None
    own = rows.filter(sieve(F.col(id_col), several, F.col(id_col))).select(id_col, F.col(node).alias("b")).distinct()
    return own.join(several, id_col).select("a", "b")
