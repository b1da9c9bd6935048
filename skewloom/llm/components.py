"""Connected components by alternating star contraction, as joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewloom.session import Scratch


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node root`` for every node of ``edges(u, v)``; the root is the least node of the component.

    Each round hangs every node's larger neighbours under its least neighbour (large star), then its
    smaller neighbours (small star). Rounds grow with the logarithm of the largest component. Minima
    are combined before the shuffle, and the edges of a node with very many neighbours are split by
    the skew join. Every round is a written table.
    """
    e = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("n", "m").alias("m")), "low")
        large = both.join(low, both["u"] == low["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(large.where("u <> v").distinct(), "large")
        least = scratch.table(large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")), "least")
        small = large.join(least, large["u"] == least["n"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u <> v")
        after = scratch.table(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small")
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        scratch.drop(e, low, large, least)
        e = after
        if (state["n"], state["s"]) == before:
            break
        before = (state["n"], state["s"])
    # Each node now hangs under its root.
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
