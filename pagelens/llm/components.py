"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node, both with bounded state per row; a node with very
many edges is pre-aggregated before its shuffle and its join can be split by adaptive execution. Edges
and labels stay distributed; only a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.storage import discard, stored


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return edges.join(least, "v").select("u", F.least("v", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, steps: int | None = None) -> DataFrame:
    """(node, component) for every node of `links` (columns a, b): component is the least node reachable.

    Self-links and rows with a null end say nothing and are left out; repeated links are harmless. With `steps`, after
    so many steps at most: nodes of one component are then connected, but connected nodes may still be in two.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    done, seen = 0, None if steps else _checksum(edges)
    while done != steps and (seen is None or seen[0]):
        after = stored(_small_star(_large_star(edges)))
        discard(edges)
        edges, done = after, done + 1
        if steps is None:
            now = _checksum(after)
            if now == seen:
                break
            seen = now
    # `edges` is read when the result is, so it stays until the application ends
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    if steps is None:
        return both.unionByName(roots.distinct())
    return both.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
