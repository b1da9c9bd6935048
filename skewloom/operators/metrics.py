"""Structural measures: degrees, connectivity, path length, clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewloom.session import Scratch

from .graph import Graph
from .pairs import hop_sums, small_rows
from .traversal import all_levels, bfs


def degree_stats(graph: Graph) -> DataFrame:
    """One row: vertices, edges, average, least and greatest out-degree and the first vertex that has each."""
    d = graph.out_degree()
    return d.agg(
        F.count("*").alias("n_nodes"), F.sum("degree").alias("n_edges"), F.avg("degree").alias("avg_degree"),
        F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"),
        F.min(F.struct("degree", "id"))["id"].alias("min_node"), F.max(F.struct("degree", (-F.col("id")).alias("neg")))["neg"].alias("neg_max_node"),
    ).withColumn("max_node", -F.col("neg_max_node")).drop("neg_max_node")


def degree_histogram(graph: Graph) -> DataFrame:
    """``degree count``, degrees without a vertex left out."""
    return graph.out_degree().groupBy("degree").agg(F.count("*").alias("count"))


def is_connected(graph: Graph, source: int) -> DataFrame:
    """One row: whether the levels from ``source`` reach every vertex, and how many they do not."""
    reached = bfs(graph, source).select(F.col("id").alias("r"))
    missed = graph.vertices.join(reached, graph.vertices["id"] == reached["r"], "left_anti")
    return missed.agg(F.count("*").alias("unreached")).select((F.col("unreached") == 0).alias("connected"), "unreached")


def _hops(scratch: Scratch, graph: Graph) -> DataFrame:
    """``v hops pairs``: the sum of hops to each vertex from all others that reach it, and how many do; absent if none does.

    Only a graph that does not fit in the memory of a task takes a row for each pair.
    """
    rows = small_rows(scratch, graph)
    if rows is not None:
        return hop_sums(scratch, rows, graph.vertices)
    _, state = all_levels(scratch, graph, graph.vertices)
    return state.where("s <> v").groupBy("v").agg(F.sum("level").alias("hops"), F.count("*").alias("pairs"))


def characteristic_path_length(graph: Graph) -> DataFrame:
    """One row ``path_length``: mean hops over ordered pairs of vertices; null if some pair is not connected."""
    scratch = Scratch(graph.edges.sparkSession, "path-length")
    n = graph.vertices.count()
    sums = _hops(scratch, graph).agg(F.sum("hops").alias("hops"), F.sum("pairs").alias("pairs"))
    return sums.select(F.when((F.col("pairs") == n * (n - 1)) & (F.col("pairs") > 0), F.col("hops") / F.col("pairs")).alias("path_length"))


def clustering(graph: Graph) -> DataFrame:
    """``id coefficient`` over undirected edges given both ways: weight among neighbours by possible edges; 0 below two.

    Edges without a ``weight`` weigh one each; parallel edges add up; the neighbours are distinct. The triangle join sends the
    smaller neighbour lists: wedges are made at the end of an edge with the lower degree.
    """
    weight = F.sum("weight") if "weight" in graph.edges.columns else F.count("*")
    one = graph.edges.where("src <> dst").groupBy("src", "dst").agg(weight.alias("n"))
    k = one.groupBy(F.col("src").alias("k_id")).agg(F.count("*").alias("k"))
    ranked = one.join(k, one["src"] == k["k_id"]).select("src", "dst", "n", F.struct("k", "src").alias("a"))
    other = k.select(F.col("k_id").alias("b_id"), F.struct(F.col("k"), F.col("k_id").alias("src")).alias("b"))
    up = ranked.join(other, ranked["dst"] == other["b_id"]).where("a < b").select("src", "dst", "n")
    x, y = up.select(F.col("src").alias("p"), F.col("dst").alias("q"), F.col("n").alias("n_pq")), up.select(F.col("src").alias("p2"), F.col("dst").alias("r"), F.col("n").alias("n_pr"))
    wedge = x.join(y, (x["p"] == y["p2"]) & (x["q"] < y["r"]))
    z = one.select(F.col("src").alias("zq"), F.col("dst").alias("zr"), F.col("n").alias("n_qr"))
    tri = wedge.join(z, (F.col("q") == F.col("zq")) & (F.col("r") == F.col("zr")))
    each = tri.select(F.explode(F.array(F.struct(F.col("p").alias("v"), F.col("n_qr").alias("w")), F.struct(F.col("q").alias("v"), F.col("n_pr").alias("w")), F.struct(F.col("r").alias("v"), F.col("n_pq").alias("w")))).alias("t"))
    among = each.groupBy(F.col("t.v").alias("t_id")).agg(F.sum("t.w").alias("among"))
    out = graph.vertices.join(k, F.col("id") == F.col("k_id"), "left").join(among, F.col("id") == F.col("t_id"), "left")
    value = F.when(F.col("k") >= 2, F.coalesce("among", F.lit(0)) / (F.col("k") * (F.col("k") - 1) / 2)).otherwise(0.0)
    return out.select("id", value.cast("double").alias("coefficient"))


def mean_clustering(graph: Graph) -> DataFrame:
    """One row ``coefficient``: the mean over all vertices."""
    return clustering(graph).agg(F.avg("coefficient").alias("coefficient"))


def small_world_trials(spark: SparkSession, n: int, degree: int, p: float, trials: int = 500, seed: int = 1) -> DataFrame:
    """``trial rewired path_ratio cluster_ratio``: mean path length and clustering of rewired ring lattices by those of the lattice.

    All trials are one graph of ``trials`` parts beside the lattice, so the measures are taken in one pass over all of them.
    A part that is not connected has a null path ratio.
    """
    from skewloom.sources.generators import ring, small_world

    scratch = Scratch(spark, "trials")
    lattice = ring(spark, n, degree).select(F.lit(0).cast("long").alias("trial"), "src", "dst")
    parts = lattice
    for t in range(1, trials + 1):
        parts = parts.unionByName(small_world(spark, n, degree, p, True, seed + t).edges.select(F.lit(t).cast("long").alias("trial"), "src", "dst"))
    parts = scratch.table(parts, "parts")
    apart = parts.select("trial", (F.col("src") + F.col("trial") * n).alias("src"), (F.col("dst") + F.col("trial") * n).alias("dst"))
    whole = Graph(spark.range(n * (trials + 1)).select("id"), apart).symmetrize()
    part = lambda c: F.floor(F.col(c) / n).cast("long").alias("trial")
    hops = _hops(scratch, whole).groupBy(part("v")).agg(F.sum("hops").alias("hops"), F.sum("pairs").alias("pairs"))
    length = hops.select(F.col("trial").alias("l_trial"), F.when(F.col("pairs") == n * (n - 1), F.col("hops") / F.col("pairs")).alias("path"))
    cluster = clustering(whole).groupBy(part("id")).agg(F.avg("coefficient").alias("cluster"))
    kept = parts.join(lattice.select(F.col("src").alias("a"), F.col("dst").alias("b")), (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b")), "left")
    rewired = kept.groupBy(F.col("trial").alias("r_trial")).agg(F.sum(F.col("a").isNull().cast("long")).alias("rewired"))
    every = cluster.join(length, F.col("trial") == F.col("l_trial")).join(rewired, F.col("trial") == F.col("r_trial"))
    measured = scratch.table(every.select("trial", "rewired", "path", "cluster"), "measured")
    base = measured.where("trial = 0").first()
    ratio = lambda c: F.when(F.lit(base[c] or 0.0) > 0, F.col(c) / F.lit(base[c])).alias(f"{c}_ratio")
    return measured.where("trial > 0").select("trial", "rewired", ratio("path"), ratio("cluster"))
