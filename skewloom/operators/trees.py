"""Trees given by parent: ``node parent``, the root's parent null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewloom.plans.fixpoint import levels
from skewloom.session import Scratch


def tree_levels(scratch: Scratch, tree: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of each level, and all of them: ``node parent level``."""
    edges = scratch.table(tree.select("node", "parent"), "tree")

    def step(front: DataFrame, visited: DataFrame, k: int, rows: int) -> DataFrame:
        up = front.select(F.col("node").alias("p"))
        return edges.join(up, edges["parent"] == up["p"]).select("node", "parent", F.lit(k).alias("level"))

    parts, result = levels(scratch, edges.where("parent IS NULL").withColumn("level", F.lit(0)), step)
    return parts, result.state


def descendants(tree: DataFrame, strategy: str = "bottom_up") -> DataFrame:
    """``node descendants``, the node itself included.

    ``bottom_up`` sums children level by level and moves each node once; ``ancestors`` walks every node up
    to the root, as many rows as the sum of depths.
    """
    scratch = Scratch(tree.sparkSession, "tree")
    if strategy == "ancestors":
        base = scratch.table(tree.select("node", "parent"), "tree")
        walk, out = base.select(F.col("node").alias("anc"), F.col("parent").alias("next")), []
        while True:
            out.append(walk)
            up = base.select(F.col("node").alias("b"), F.col("parent").alias("then"))
            walk = scratch.table(walk.join(up, walk["next"] == up["b"]).select(F.col("b").alias("anc"), F.col("then").alias("next")), "walk")
            if walk.isEmpty():
                break
        every = out[0]
        for w in out[1:]:
            every = every.unionByName(w)
        return every.groupBy(F.col("anc").alias("node")).agg(F.count("*").alias("descendants"))
    if strategy != "bottom_up":
        raise ValueError("strategy must be bottom_up or ancestors")
    parts, _ = tree_levels(scratch, tree)
    below, done = None, []
    for part in reversed(parts):
        if below is None:
            made = part.select("node", "parent", F.lit(1).cast("long").alias("descendants"))
        else:
            sums = below.groupBy(F.col("parent").alias("c")).agg(F.sum("descendants").alias("sum"))
            made = part.join(sums, part["node"] == sums["c"], "left").select("node", "parent", (1 + F.coalesce("sum", F.lit(0))).cast("long").alias("descendants"))
        below = scratch.table(made, "sums")
        done.append(below)
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.select("node", "descendants")


def height(tree: DataFrame) -> DataFrame:
    """One row ``height``: the greatest level, the root's being 0."""
    return tree_levels(Scratch(tree.sparkSession, "height"), tree)[1].agg(F.max("level").alias("height"))
