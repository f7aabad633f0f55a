"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest of each node and its neighbours, combined within tasks first."""
    return stored(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, which has none itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger")))
    counts = ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
    return counts.filter("smaller + larger > 1 and smaller > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (u, v); the component is its smallest node.

    Each round writes its edges to the shared folder. Both joins meet written
    tables, so hot nodes are split by adaptive execution. A large-star has one
    row for each edge at most, equal ones go with the small-star that follows.
    Rounds end when all that is left are stars around their smallest nodes.
    """
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _all_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
        small = large.join(_least(large), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = stored(small.filter("u <> v").distinct(), "small-star")
    centres = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stored(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres), "components")


def joined_on(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further ``links`` (u, v) between components of ``labels``, or nodes that have none there."""
    further = components(links)
    moved = labels.join(further.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    new = further.join(labels.select("node"), "node", "left_anti")
    return moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(new)
