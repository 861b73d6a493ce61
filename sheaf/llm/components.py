"""Connected components by star contraction, without any node's neighbours in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from sheaf.session import stage


def components(edges: DataFrame, stage: Callable[[DataFrame], DataFrame] = stage) -> DataFrame:
    """(node, root) for every node that ``edges(src, dst)`` touches; the root is the smallest node reachable.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest of them. Both steps join
    the edges with one row per node, so adaptive execution may split a node with very many edges. Rounds grow with
    the logarithm of the longest chain; each ends as a table that ``stage`` writes, so lineage stays one round long."""
    edges = stage(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
                  .distinct())
    before = _state(edges)
    while True:
        edges = stage(_small_star(_large_star(edges)))
        after = _state(edges)
        if after == before:
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(
                edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
        before = after


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(src, dst))")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()
