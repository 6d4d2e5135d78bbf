"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (large) or smaller neighbours, and itself, to the smallest one it knows."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(low, "u")
    linked = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = low.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(own).where("a != b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) for every node that has a link. Self-links and repeats are ignored."""
    edges = written(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct())
    state = None
    while True:
        edges = written(_star(_star(edges, True), False))
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
