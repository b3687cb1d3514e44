"""Connected components by alternating large-star and small-star steps.

Each step is an aggregation and a join on tables written to the shared folder, so no
list of neighbours is ever gathered and the join of a hot vertex can be split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, scratch: Scratch, name: str, small: bool) -> DataFrame:
    """edges: (u, v) with u > v."""
    pairs = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.write(pairs.groupBy("u").agg(F.min("v").alias("m")), f"{name}-min").withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    if small:
        linked = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        linked = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = linked.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    return scratch.write(out, name)


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex has one edge, to a root: no target is a source."""
    many = edges.groupBy("u").agg(F.count("*").alias("k")).where("k > 1")
    below = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
    return not many.limit(1).count() and not below.limit(1).count()


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """links (a, b) -> (id, component): the smallest id reachable, for every id with a link."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.write(edges, f"{name}-0")
    k = 0
    while not _settled(edges):
        k += 1
        big = _star(edges, scratch, f"{name}-{k}l", small=False)
        edges = _star(big, scratch, f"{name}-{k}s", small=True)
        for old in (f"{name}-{k}l", f"{name}-{k}l-min", f"{name}-{k}s-min", f"{name}-{k - 1}s" if k > 1 else f"{name}-0"):
            scratch.drop(old)
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
