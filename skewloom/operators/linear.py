"""Sparse linear algebra over edges: PageRank, matrix-vector product, walk counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skewloom.plans.skew import Gather, gather
from skewloom.session import Scratch

from .graph import Graph


def pagerank(graph: Graph, damping: float = 0.5, total: float = 1000.0, tolerance: float = 1e-13, max_rounds: int = 100, strategy: str = "auto") -> DataFrame:
    """``id rank``: ranks that sum to ``total``; the rank of vertices without out-edges is shared by all.

    Stops when no rank changes by more than ``tolerance`` or after ``max_rounds`` rounds. Ranks of vertices without out-edges
    only count in sum for the next round, and that sum is known from the ranks of their sources; so rounds go over the other
    vertices, and their own ranks are made from the last round. A round reads back two numbers: that sum, and the largest change.
    """
    scratch = Scratch(graph.edges.sparkSession, "pagerank")
    n = graph.vertices.count()
    first, share = total / max(n, 1), damping / max(n, 1)
    degree = graph.edges.groupBy(F.col("src").alias("d_src")).agg(F.count("*").alias("degree"))
    weighed = graph.multiplicity().join(degree, F.col("src") == F.col("d_src")).select("src", "dst", (F.col("n") / F.col("degree")).alias("part"))
    vertices = scratch.table(graph.vertices.join(degree, F.col("id") == F.col("d_src"), "left").select("id", F.col("d_src").isNull().alias("dangling")), "vertices")
    marked = scratch.table(weighed.join(vertices, F.col("dst") == F.col("id")).select("src", "dst", "part", "dangling"), "edges")
    edges = Gather(scratch, marked.where("NOT dangling").drop("dangling"), "src", strategy)
    outward = marked.where("dangling").drop("dangling")
    ends = vertices.where("dangling").select("id")
    n_ends = ends.count()
    lose = outward.groupBy(F.col("src").alias("l_id")).agg(F.sum("part").alias("loses"))
    # The rank, those of the last two rounds, and which part of it goes to vertices without out-edges.
    start = vertices.where("NOT dangling").join(lose, F.col("id") == F.col("l_id"), "left")
    state, lossy, _ = _ranked(scratch, start.select("id", F.lit(first).alias("rank"), *[F.lit(first).alias(c) for c in ("last", "last2")], F.coalesce("loses", F.lit(0.0)).alias("loses")), "rank0")
    lost, base, base2, rounds = n_ends * first, first, first, 0

    def end_ranks(column: str, start: float) -> DataFrame:
        """``id rank`` of the vertices without out-edges, as the ranks in ``column`` give them."""
        met = gather(outward, "src", state.select(F.col("id").alias("s"), F.col(column).alias("r")), "s", strategy)
        flow = met.groupBy(F.col("dst").alias("f_id")).agg(F.sum(F.col("r") * F.col("part")).alias("flow"))
        return ends.join(flow, F.col("id") == F.col("f_id"), "left").select("id", (F.coalesce("flow", F.lit(0.0)) * damping + start).alias("rank"))

    for k in range(1, max_rounds + 1):
        base, base2 = (1 - damping) * first + share * lost, base
        lost = n_ends * base + damping * lossy
        met = edges.join(state.select(F.col("id").alias("s"), F.col("rank").alias("r")), "s", n - n_ends)
        flow = met.groupBy(F.col("dst").alias("f_id")).agg(F.sum(F.col("r") * F.col("part")).alias("flow"))
        both = state.join(flow, state["id"] == flow["f_id"], "left")
        rank = F.coalesce("flow", F.lit(0.0)) * damping + base
        after, lossy, change = _ranked(scratch, both.select("id", rank.alias("rank"), F.col("rank").alias("last"), F.col("last").alias("last2"), "loses"), f"rank{k}")
        scratch.drop(state)
        state, rounds = after, k
        if k < max_rounds and change <= tolerance:
            now = end_ranks("last", base)
            was = ends.select("id", F.lit(first).alias("rank")) if k == 1 else end_ranks("last2", base2)
            was = was.select(F.col("id").alias("w_id"), F.col("rank").alias("was"))
            if (now.join(was, F.col("id") == F.col("w_id")).agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0) <= tolerance:
                break
    ended = end_ranks("last", base) if rounds else ends.select("id", F.lit(first).alias("rank"))
    return scratch.finish(scratch.table(state.select("id", "rank").unionByName(ended), "ranks"))


def _ranked(scratch: Scratch, df: DataFrame, name: str) -> tuple[DataFrame, float, float]:
    """The written ranks, how much of them goes to vertices without out-edges, and the largest change."""
    seen = Observation()
    out = scratch.table(df.observe(seen, F.sum(F.col("rank") * F.col("loses")).alias("lossy"), F.max(F.abs(F.col("rank") - F.col("last"))).alias("change")), name)
    return out, seen.get["lossy"] or 0.0, seen.get["change"] or 0.0


def synthetic_matrix(scratch: Scratch, graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Matrix ``row col val`` valued by place in row-compressed order, and vector ``id x`` valued by id."""
    placed = graph.csr_positions(scratch)
    matrix = placed.select(F.col("src").alias("row"), F.col("dst").alias("col"), (F.col("i") % 13 + 0.5).cast("double").alias("val"))
    return matrix, graph.vertices.select("id", (F.col("id") % 17 + 0.5).cast("double").alias("x"))


def spmv(matrix: DataFrame, vector: DataFrame, rows: DataFrame, strategy: str = "auto") -> DataFrame:
    """``id y``: matrix times vector for every row of ``rows(id)``; an empty row gives zero."""
    met = gather(matrix, "col", vector.select(F.col("id").alias("c"), "x"), "c", strategy)
    sums = met.groupBy("row").agg(F.sum(F.col("val") * F.col("x")).alias("sum"))
    return rows.join(sums, rows["id"] == sums["row"], "left").select("id", F.coalesce("sum", F.lit(0.0)).alias("y"))


def walks(graph: Graph, length: int) -> DataFrame:
    """``src dst n``: walks of ``length`` edges, parallel edges apart."""
    one = graph.multiplicity()
    out = one
    for _ in range(length - 1):
        step = one.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("n").alias("m"))
        out = out.join(step, out["dst"] == step["mid"]).groupBy("src", F.col("end").alias("dst")).agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    return out
