"""Connected components by alternating large-star and small-star steps over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on its smallest neighbour (or itself)."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hangs itself and its smaller neighbours on the smallest of them. Edges point from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(scratch: Scratch, links: DataFrame, tag: str) -> DataFrame:
    """(node, component): every node of the links (a, b) with the smallest node it can reach; other nodes are absent.

    Rounds shrink every path's length by a constant factor, so they are few, and go on until one changes nothing; each is a written
    table, so lineage stays short and nothing but a count and two checksums reaches the driver. Nodes are any longs, negative ones and the
    ends of the range too. No links give an empty table.
    """
    edges = scratch.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{tag}-0")
    seen, k = None, 0
    while True:
        k += 1
        edges = scratch.table(_small_star(_large_star(edges)), f"{tag}-{k}")
        # checksums that no id can make overflow
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        scratch.drop(f"{tag}-{k - 1}")
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
