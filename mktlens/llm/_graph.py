"""Connected components of an edge table by alternating star operations."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktlens.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b): each node of an edge with the least node that it reaches,
    as (node, root).

    Each round points every node at the least of its neighbours, first from the
    larger ones (large star), then among the smaller ones (small star); minima are
    map-side combined aggregates joined back to the edges, so no task gathers a
    node's neighbours.  The edges are checkpointed every round; the driver sees a
    count and a checksum.  Rounds grow with the logarithm of the longest path.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut_lineage(e)
    seen = _sum(e)
    while seen[0]:
        e = cut_lineage(_small_star(_large_star(e)))
        now = _sum(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()


def _sum(e: DataFrame) -> tuple:
    # decimals: a checksum must not overflow
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
    # neighbours larger than x, to x's least
    larger = e.select(F.col("v").alias("x"), F.col("u").alias("y"))
    return larger.join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
