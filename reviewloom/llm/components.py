"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import staged


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reached) for every node of `links` (a, b: long).

    Each round rewires all links to smaller nodes, first from the side of the larger neighbours, then of the smaller ones,
    until all links are stars around the components' smallest nodes. Every round is written to the shared
    folder. Minima are combined before the shuffle and the one join per step is an ordinary one that adaptive execution splits
    where a node has very many links.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select("v", "m", "u")
        rewired = (small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                   .unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
        edges = staged(rewired, "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none, or larger ones only."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counted.filter((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()
