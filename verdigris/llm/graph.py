"""Connected components of large sets of links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that links a, b reach, for every node that has a link.

    Each round sends every node to the least of itself and its neighbours and contracts the links, until
    none is left; nodes then follow the rounds' moves. A hub is one row per task in the sums and a skewed join
    key otherwise. Self-links and repeated links change nothing; no links give no rows."""
    edges = links.where("a IS NOT NULL AND b IS NOT NULL")
    place = saved(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct(), "nodes").withColumn("component", F.col("node"))
    edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = saved(both.groupBy("a").agg(F.min("b").alias("to")).where("to < a"), "moves")
        ends = reduce(lambda e, side: e.join(move.select(F.col("a").alias(side), F.col("to").alias(f"to_{side}")), side, "left"), ("a", "b"), edges)
        moved = ends.select(F.coalesce("to_a", "a").alias("u"), F.coalesce("to_b", "b").alias("v")).where("u <> v")
        edges = saved(moved.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "edges")
        step = move.select(F.col("a").alias("component"), "to")
        place = saved(place.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "places")
    return place
