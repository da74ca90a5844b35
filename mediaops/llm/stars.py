"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .work import keep


def _with_least(neighbours: DataFrame) -> DataFrame:
    """``neighbours`` (u, v) with the least node among u and its neighbours; a node may have most of the rows."""
    least = neighbours.groupBy("u").agg(F.least("u", F.min("v")).alias("least"))
    return lookup_join(neighbours, least, ["u"], spread_by=["v"], how="inner")


def large_star(edges: DataFrame) -> DataFrame:
    """Every node's greater neighbours are linked to the least of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lesser neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return (_with_least(down).select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e"))
            .select("e.*").where("u <> v").distinct())


def star_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links ``a``-``b``, for every node linked with another.

    Both operations keep what is connected connected and never raise the number of links by more than the nodes; alternating
    they end, after about the logarithm of the number of nodes in rounds, in stars around the smallest nodes. Links with a null end are ignored.
    """
    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, now = None, state(edges)
    while now != before:
        edges = keep(small_star(keep(large_star(edges), "large")), "small")
        before, now = now, state(edges)
    centres = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres.withColumn("component", F.col("node")))
