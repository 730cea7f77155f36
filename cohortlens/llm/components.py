"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import durable


#: Edges in one task of the tables between rounds.
TASK_EDGES = 500_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``u, v``; the root is the smallest node of the component.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest
    of them, until the edges are stars. The number of rounds grows with the logarithm of the
    number of nodes. A node with very many edges is summed in parts, and its edges are split
    among tasks where they meet its smallest neighbour.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = durable(edges.distinct())
    state = _state(edges)
    while state[0]:
        # rounds never add edges: their number tells how many tasks the next tables need
        tasks = 1 + state[0] // TASK_EDGES
        both = _both(edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.where("u != v").distinct().coalesce(tasks))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u != v")
        edges = durable(small.distinct().coalesce(tasks))
        last, state = state, _state(edges)
        if state == last:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
