"""Connected components of links by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.store import kept


def settled(edges: DataFrame) -> bool:
    """Whether distinct links (u, v), u > v, are stars: each u has one, to a node that has none itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("out").alias("links"), F.min("out").alias("least")).where("links > 1 OR links = 1 AND least = 0").count() == 0


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of links (a, b).

    Every round replaces each node's links by links to its smallest neighbour, first among the
    larger, then among the smaller; rounds grow with the logarithm of a component's width. A
    round's edges are a written table, so no lineage builds up; nothing but a count reaches
    the driver. Links of a node with itself and repeated links don't matter; no links, no rows.
    """
    if links.isEmpty():
        return links.sparkSession.createDataFrame([], "node long, component long")
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not settled(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = kept(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(edges.select("v", "v").distinct())


def joined(placed: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) once more links are known; only a node's link to its component takes part again, and nothing if there are no more."""
    if links.isEmpty():
        return placed
    return components(placed.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links.select("a", "b")))
