"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import keep


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links ``a``-``b``, for every linked node.

    Each round, every node takes the smallest label among its neighbours, hands it to the
    node its own label names, and follows labels one step further; the rounds grow with the
    logarithm of the longest path. All of it is joins and minima with map-side combining, so a
    node with very many links is no more than a skewed join key. Links with a null end are ignored.
    """
    edges = keep(links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                                F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u is not null and v is not null").distinct(), "edges")
    labels = keep(edges.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label"))
                  .withColumn("changed", F.lit(True)), "labels")
    while labels.where("changed").limit(1).count():
        near = (edges.join(labels.select(F.col("node").alias("v"), "label"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("label").alias("best")))
        offers = near.join(labels.select("node", "label"), "node")
        best = (offers.select(F.explode(F.array(
                    F.struct("node", F.least("best", "label").alias("best")),
                    F.struct(F.col("label").alias("node"), F.col("best")))).alias("o"))
                .select("o.*").groupBy("node").agg(F.min("best").alias("best")))
        met = labels.select("node", "label").join(best, "node").select(
            "node", "label", F.least("label", "best").alias("next"))
        met = keep(met, "met")
        jump = met.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        labels = keep(met.join(jump, "next").select(
            "node", F.least("next", "beyond").alias("label"), (F.least("next", "beyond") < F.col("label")).alias("changed")),
            "labels")
    return labels.select("node", F.col("label").alias("component"))
