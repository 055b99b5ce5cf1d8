"""Connected components of a link table by alternating large-star and small-star steps (Kiveris and others, 2014).

Every step is one grouping with partial aggregation and one join, so hubs with very many links are fine; each round is
written as a table. Links never reach the driver, which only sees two numbers per round to notice the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellset.session import materialize


def star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` has ``a > b``. Neighbours are hung on the smallest one: all larger ones, or the node with its smaller ones."""
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("m"))
    joined = both.join(least, both["a"] == least["node"])
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a``, ``b``, comparable ids); the component is its smallest node.

    Self links and repeated links do no harm; nodes without any other node are left out; no links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = materialize(edges), None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == seen or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = tuple(now)
        edges = materialize(star(materialize(star(edges, large=True)), large=False))
