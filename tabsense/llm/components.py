"""Connected components by alternating large-star and small-star."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, parts_for

EDGES = 2_000_000  # per partition
FEW = 500_000  # edges whose minima (16 MB) are broadcast


def _linked_to_least(pairs: DataFrame, edges: int, parts: int) -> DataFrame:
    """Rows (u, v, m): m is the smallest of u and all its v. The minima (at most two
    rows an edge) are broadcast for few edges, else a table of their own, so that the
    join may split the rows of a hub."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if edges <= FEW:
        return pairs.join(F.broadcast(least), "u")
    return pairs.join(cut_lineage(least.coalesce(parts)), "u")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or has one edge, to a centre."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("centre")) \
        .unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("child"),
                                  F.lit(1).alias("centre")))
    sums = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("centre").alias("centre"))
    return sums.filter("child + centre > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of the edges (u, v: long): the smallest
    node reachable. Self-links and repeated edges do no harm; an empty table gives
    an empty one. Both steps keep the components and end in stars around them;
    the work per step is a sum or join over edges, never a group in one place."""
    now = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"),
                                                    F.least("u", "v").alias("v")).distinct())
    n_edges = now.count()
    parts = parts_for(n_edges, EDGES)
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _linked_to_least(both, n_edges, parts).filter("v > u and v <> m") \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = cut_lineage(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                           .coalesce(parts))
        small = _linked_to_least(down, n_edges, parts)
        now = cut_lineage(small.select("u", F.col("m").alias("v")).unionByName(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
            .coalesce(parts))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
