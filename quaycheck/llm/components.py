"""Connected components of a link table by alternating stars; links and labels stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaycheck.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that the links (a, b) name; a component is called by its smallest node.

    A large star sends each node's larger neighbours to the smallest node near it, a small star the smaller ones; the
    rounds end when only stars are left. Each node's smallest neighbour comes from an aggregation and is joined on,
    so that a node of very many links is not gathered anywhere.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v > u").distinct(), "links")
    while not _only_stars(edges):
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = staged(both.join(low, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct(), "large")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").where("v > u").distinct()
        edges = staged(small, "links")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _only_stars(edges: DataFrame) -> bool:
    """Whether every larger end v has one edge and is no smaller end u of another: then each u is the smallest of its component."""
    one, none = F.lit(1).alias("v"), F.lit(0).alias("v")
    ends = edges.select(F.col("v").alias("x"), one).unionByName(edges.select(F.col("u").alias("x"), none))
    return not ends.groupBy("x").agg(F.sum("v").alias("n"), F.min("v").alias("least")).where("n > 1 OR (n = 1 AND least = 0)").limit(1).count()


def grown(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) as `components` gives them once `links` (a, b) are added to those that gave `labels`."""
    if not links.limit(1).count():
        return labels
    end = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"_{x}"))
    named = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    tops = components(named).select(F.col("node").alias("component"), F.col("component").alias("top"))
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    return labels.unionByName(new).join(tops, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
