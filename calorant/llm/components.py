"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorant.llm.common import checkpoint


def _hung(edges: DataFrame, both: bool) -> DataFrame:
    """Hang neighbours of each node on the smallest of them (or the node itself).

    both: of each node's larger neighbours (the large star), else of its smaller ones (the small star).
    The smallest neighbour is found by a pre-aggregated minimum; no node's neighbours are gathered.
    """
    near = edges.union(edges.select("b", "a")) if both else edges
    low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    hung = near.join(low, "a")
    hung = hung.where("b > a").select("b", "low") if both else hung.select("b", "low").union(hung.select("a", "low"))
    return hung.toDF("a", "b").where("a > b").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Each node of edges (a, b) with the smallest node that it reaches: node, component.

    Nodes that reach themselves alone are left out, as are edges with a null. Each round's edges are
    checkpointed. Raises if the labels haven't settled after `rounds` rounds.
    """
    now = checkpoint(edges.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        now = checkpoint(_hung(_hung(now, True), False))
        last, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == last:
            return now.toDF("node", "component")
    raise RuntimeError(f"components haven't settled after {rounds} rounds")
