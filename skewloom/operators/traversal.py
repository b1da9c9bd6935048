"""Level-synchronous traversal: BFS, shortest paths, betweenness, id-ordered colouring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewloom.plans.fixpoint import improve, levels
from skewloom.plans.skew import STRATEGIES, Gather
from skewloom.session import Scratch

from .graph import Graph
from .pairs import dependency_sums, small_rows


def bfs(graph: Graph, source: int, strategy: str = "auto") -> DataFrame:
    """``id level`` of the vertices reached from ``source``: fewest hops along out-edges."""
    spark = graph.edges.sparkSession
    scratch = Scratch(spark, "bfs")
    edges = Gather(scratch, scratch.table(graph.edges.select("src", "dst").distinct(), "edges"), "src", strategy)

    def step(front: DataFrame, visited: DataFrame, k: int, rows: int) -> DataFrame:
        near = edges.join(front.select(F.col("id").alias("f")), "f", rows).select(F.col("dst").alias("id")).distinct()
        return near.join(visited.select(F.col("id").alias("v")), near["id"] == F.col("v"), "left_anti").withColumn("level", F.lit(k))

    start = spark.createDataFrame([(source, 0)], "id long, level int")
    return scratch.finish(levels(scratch, start, step)[1].state.select("id", "level"))


def sssp(graph: Graph, source: int, strategy: str = "auto") -> DataFrame:
    """``id cost`` of the vertices reached: least sum of non-negative edge weights."""
    spark = graph.edges.sparkSession
    scratch = Scratch(spark, "sssp")
    edges = Gather(scratch, scratch.table(graph.edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "edges"), "src", strategy)

    def offers(front: DataFrame, rows: int) -> DataFrame:
        met = edges.join(front.select(F.col("id").alias("f"), F.col("cost").alias("so_far")), "f", rows)
        return met.groupBy(F.col("dst").alias("id")).agg(F.min(F.col("so_far") + F.col("weight")).alias("cost"))

    start = spark.createDataFrame([(source, 0)], "id long, cost long")
    return scratch.finish(improve(scratch, start, offers, "cost", True).state.select("id", "cost"))


def shortest_path(graph: Graph, source: int, target: int) -> DataFrame:
    """One row ``path cost``: the vertices of a cheapest path; no row if there is none.

    Of equally cheap predecessors the least id is taken. Weights must be positive. The path is found by pointer doubling, so
    rounds grow with the logarithm of its length.
    """
    spark = graph.edges.sparkSession
    scratch = Scratch(spark, "path")
    costs = scratch.table(sssp(graph, source), "costs")
    e = graph.edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    a, b = costs.select(F.col("id").alias("s"), F.col("cost").alias("sc")), costs.select(F.col("id").alias("d"), F.col("cost").alias("dc"))
    tight = e.join(a, F.col("src") == F.col("s")).join(b, F.col("dst") == F.col("d")).where((F.col("sc") + F.col("weight") == F.col("dc")) & (F.col("dst") != source))
    jump = scratch.table(tight.groupBy(F.col("dst").alias("at")).agg(F.min("src").alias("to")), "before")
    on, n, reach = scratch.table(costs.where(F.col("id") == target).select("id"), "on"), 1, 1
    while n == reach:  # after k rounds the last 2^k vertices, unless the path is shorter
        near = on.join(jump, on["id"] == jump["at"]).select(F.col("to").alias("id"))
        on, n = scratch.counted(on.unionByName(near).distinct(), "on")
        reach *= 2
        if n == reach:
            far = jump.select(F.col("at").alias("at2"), F.col("to").alias("to2"))
            jump = scratch.table(jump.join(far, jump["to"] == far["at2"]).select("at", F.col("to2").alias("to")), "jump")
    ends = on.join(costs.select(F.col("id").alias("c_id"), "cost"), F.col("id") == F.col("c_id"))
    path = ends.agg(F.sort_array(F.collect_list(F.struct("cost", "id"))).alias("p"), F.max("cost").alias("cost")).where("cost IS NOT NULL")
    return scratch.finish(path.select(F.col("p.id").alias("path"), "cost"))


def all_levels(scratch: Scratch, graph: Graph, sources: DataFrame, strategy: str = "auto") -> tuple[list[DataFrame], DataFrame]:
    """Levels ``s v level sigma`` from all ``sources(id)`` at once; sigma counts shortest paths, parallel edges apart.

    The state has a row for each source and each vertex that it reaches; bound the sources on a large graph.
    """
    edges = Gather(scratch, scratch.table(graph.multiplicity(), "edges"), "src", strategy)

    def step(front: DataFrame, visited: DataFrame, k: int, rows: int) -> DataFrame:
        near = edges.join(front.select("s", "v", "sigma"), "v", rows).groupBy("s", F.col("dst").alias("v")).agg(F.sum(F.col("sigma") * F.col("n")).alias("sigma"))
        seen = visited.select(F.col("s").alias("s2"), F.col("v").alias("v2"))
        return near.join(seen, (near["s"] == seen["s2"]) & (near["v"] == seen["v2"]), "left_anti").select("s", "v", F.lit(k).alias("level"), "sigma")

    start = sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("level"), F.lit(1.0).alias("sigma"))
    parts, result = levels(scratch, start, step)
    return parts, result.state


def betweenness(graph: Graph, sources: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """``id bc`` of every vertex: directed, unnormalised; all vertices are sources by default.

    A graph that fits in the memory of a task is sent to all tasks, which walk from their sources and return a sum for each vertex.
    In a larger one all sources go through one loop over levels, forwards for path counts and backwards for dependencies, with the
    joins of ``strategy`` and a row for each source and vertex.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    scratch = Scratch(graph.edges.sparkSession, "betweenness")
    sources = graph.vertices if sources is None else sources
    rows = small_rows(scratch, graph)
    bc = dependency_sums(scratch, rows, sources) if rows is not None else _level_dependencies(scratch, graph, sources, strategy)
    return scratch.finish(graph.vertices.join(bc, graph.vertices["id"] == bc["b"], "left").select("id", F.coalesce("sum", F.lit(0.0)).alias("bc")))


def _level_dependencies(scratch: Scratch, graph: Graph, sources: DataFrame, strategy: str) -> DataFrame:
    """``b sum`` by joins, level by level."""
    edges = Gather(scratch, scratch.table(graph.multiplicity(), "multiplicity"), "src", strategy)
    parts, _ = all_levels(scratch, graph, sources, strategy)
    below, done = None, []
    for k in range(len(parts) - 1, -1, -1):
        here = parts[k].select("s", "v", "sigma")
        if below is None:
            made = here.withColumn("delta", F.lit(0.0))
        else:
            w = below.select(F.col("s").alias("ws"), F.col("v").alias("w"), F.col("sigma").alias("w_sigma"), F.col("delta").alias("w_delta"))
            met = edges.join(here, "v").join(w, (F.col("s") == F.col("ws")) & (F.col("dst") == F.col("w")))
            part = F.col("n") * F.col("sigma") / F.col("w_sigma") * (1 + F.col("w_delta"))
            sums = met.groupBy(F.col("s").alias("ss"), F.col("v").alias("sv")).agg(F.sum(part).alias("delta"))
            made = here.join(sums, (here["s"] == sums["ss"]) & (here["v"] == sums["sv"]), "left").select("s", "v", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        below = scratch.table(made, f"delta{k}")
        done.append(below)
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.where("s <> v").groupBy(F.col("v").alias("b")).agg(F.sum("delta").alias("sum"))


def coloring(graph: Graph, strategy: str = "auto") -> DataFrame:
    """``id color``: one more than the greatest colour of the smaller out-neighbours, or 1.

    A proper colouring if the edges are symmetric.
    """
    scratch = Scratch(graph.edges.sparkSession, "coloring")
    down = Gather(scratch, scratch.table(graph.edges.where("dst < src").select("src", "dst").distinct(), "edges"), "dst", strategy)

    def offers(front: DataFrame, rows: int) -> DataFrame:
        met = down.join(front.select(F.col("id").alias("f"), F.col("color").alias("c")), "f", rows)
        return met.groupBy(F.col("src").alias("id")).agg((F.max("c") + 1).alias("color"))

    start = graph.vertices.select("id", F.lit(1).alias("color"))
    return scratch.finish(improve(scratch, start, offers, "color", False).state.select("id", "color"))
