"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrain.session import Scratch

#: Far more rounds than the logarithm of any table's size; reaching it is an error, not a result.
_ROUNDS = 100


def star_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links`` (src, dst); the root is the smallest node of the component.

    Each round connects the larger neighbours of every node to its smallest neighbour, then the smaller ones.
    Both steps are an aggregation that combines before the shuffle and a join that adaptive execution can
    split, so the neighbours of one node never meet in one task. Rounds grow with the logarithm of a path's length.
    """
    edges = links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct()
    edges = scratch.settle(edges)
    before = None
    for _ in range(_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select("v", "m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.settle(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError("components did not settle")
