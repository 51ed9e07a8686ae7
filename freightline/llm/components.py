"""Connected components of an undirected edge table by alternating large and small stars.

Each round joins edges with the smallest neighbour of their nodes and writes the result to the
shared folder, so lineage stays short and no part of the graph meets the driver.  Minima are
pre-aggregated in the map tasks; a node with very many neighbours only makes a skewed join, which
adaptive execution splits.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).collect()[0]
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: columns ``a``, ``b`` of one orderable type.  Returns (node, root) for every node of
    an edge, the root being the smallest node of its component (itself included)."""
    pairs = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
    now = materialise(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    seen = _checksum(now)
    while seen[0]:
        # large star: every larger neighbour of u hangs on the smallest neighbour of u
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "star")
        release(now)
        # small star: u and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "star")
        release(large)
        after = _checksum(now)
        if after == seen:
            break
        seen = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
