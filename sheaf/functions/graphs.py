"""Breadth-first closure over edge tables, one distributed join per round."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from sheaf.session import stage


def closure(seeds: DataFrame, edges: DataFrame, keys: list[str], max_depth: int | None = None) -> DataFrame:
    """Nodes reached from ``seeds(keys…, node)`` along ``edges(keys…, src, dst)``: (keys…, node, depth).

    Every round is written to the shared folder, so lineage stays short and a lost executor re-reads
    files. A node keeps its least depth; cycles end because visited nodes are dropped. Rounds go on until no new
    node is found; a given ``max_depth`` that cuts off nodes raises instead of hiding them."""
    node = [*keys, "node"]
    frontier = stage(seeds.select(*node).distinct().withColumn("depth", F.lit(0)))
    visited = frontier
    steps = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("__next"))
    for depth in count(1):
        reached = frontier.select(*node).join(steps, node).select(*keys, F.col("__next").alias("node")).distinct()
        frontier = stage(reached.join(visited.select(*node), node, "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return visited
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"nodes lie deeper than {max_depth}")
        visited = visited.unionByName(frontier)


def successors_outside(removed: DataFrame, nexts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, node, kept): for each removed node the first kept nodes down its successor chain.

    Pointers double: after round i every removed node points 2^i steps ahead, or at the kept nodes met before. So rounds
    are logarithmic in the longest chain; 2^i steps beyond the removed nodes of a key can only be cycles."""
    node = [*keys, "node"]
    gone = stage(removed.select(*node).distinct())
    at_gone = gone.select(*keys, F.col("node").alias("at"), F.lit(True).alias("open"))
    step = nexts.select(*keys, F.col("src").alias("node"), F.col("dst").alias("at")).distinct()
    jumps = gone.join(step, node).join(at_gone, [*keys, "at"], "left")
    jumps = stage(jumps.select(*node, "at", F.coalesce("open", F.lit(False)).alias("open")))
    most, steps = gone.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0, 1
    while steps < most and not jumps.filter("open").isEmpty():
        far = jumps.select(*keys, F.col("node").alias("at"), F.col("at").alias("__far"), F.col("open").alias("__open"))
        ahead = jumps.filter("open").join(far, [*keys, "at"]).select(*node, F.col("__far").alias("at"), F.col("__open").alias("open"))
        jumps = stage(jumps.filter("NOT open").unionByName(ahead).distinct())
        steps *= 2
    return jumps.filter("NOT open").select(*node, F.col("at").alias("kept"))
