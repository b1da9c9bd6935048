"""Text reports, graph exports and dumps: one string column ``value`` each, ready for ``write.text``."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewloom.operators.graph import Graph

#: What the reports print for vertices that are not reached.
INF_COST, MAX_LEVEL = 1 << 30, 9999


def _text(df: DataFrame, form: str, *cols) -> DataFrame:
    return df.select(F.format_string(form, *cols).alias("value"))


def level_report(vertices: DataFrame, levels: DataFrame) -> DataFrame:
    """``Node i is in level l`` with ids from 1."""
    all_of = vertices.join(levels.select(F.col("id").alias("l_id"), "level"), F.col("id") == F.col("l_id"), "left").orderBy("id")
    return _text(all_of, "Node %d is in level %d", F.col("id") + 1, F.coalesce("level", F.lit(MAX_LEVEL)))


def cost_report(vertices: DataFrame, costs: DataFrame, source: int) -> DataFrame:
    all_of = vertices.join(costs.select(F.col("id").alias("c_id"), "cost"), F.col("id") == F.col("c_id"), "left").orderBy("id")
    return _text(all_of, "From Node %d -> %d is %d", F.lit(source + 1), F.col("id") + 1, F.coalesce("cost", F.lit(INF_COST)))


def bc_report(bc: DataFrame) -> DataFrame:
    return _text(bc.orderBy("id"), "Node %d: %f", F.col("id") + 1, "bc")


def rank_report(rank: DataFrame) -> DataFrame:
    return _text(rank.orderBy("id"), "Node %d: %.10f", F.col("id") + 1, "rank")


def color_report(color: DataFrame) -> DataFrame:
    return _text(color.orderBy("id"), "Node %d: %d", F.col("id") + 1, "color")


def vector_dump(df: DataFrame, index: str, value: str, name: str) -> DataFrame:
    """``name[i] = value`` lines."""
    return _text(df.orderBy(index), f"{name}[%d] = %s", F.col(index), F.col(value).cast("string"))


def _framed(body: DataFrame, head: list[str], tail: list[str], order: str) -> DataFrame:
    spark = body.sparkSession
    rows = body.select(F.lit(1).alias("part"), F.col(order).cast("long").alias("k"), "value")
    frame = spark.createDataFrame([(0, k, v) for k, v in enumerate(head)] + [(2, k, v) for k, v in enumerate(tail)], "part int, k long, value string")
    return rows.unionByName(frame).orderBy("part", "k", "value").select("value")


def dot_graph(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Graphviz text of edges ``src dst``; the smaller direction of each undirected edge."""
    arrow, kind = ("->", "digraph") if directed else ("--", "graph")
    e = edges if directed else edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return _framed(e.select("src", F.format_string(f"  %d {arrow} %d;", "src", "dst").alias("value")), [f"{kind} G {{"], ["}"], "src")


def dot_tree(tree: DataFrame) -> DataFrame:
    return dot_graph(tree.where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("node").alias("dst")))


def snap_dump(edges: DataFrame, n: int, m: int, title: str = "Directed graph", note: str = "") -> DataFrame:
    """An edge list with the four header lines that the reader of that format expects."""
    head = [f"# {title}", f"# {note}".rstrip(), f"# Nodes: {n} Edges: {m}", "# FromNodeID  ToNodeID"]
    return _framed(edges.select("src", F.format_string("%d %d", "src", "dst").alias("value")), head, [], "src")


def _kind(directed: bool, proper: bool) -> str:
    return f"{'directed' if directed else 'undirected'} {'proper graph' if proper else 'multigraph'}"


def random_graph_file(edges: DataFrame, n: int, m: int, directed: bool = True, proper: bool = True) -> DataFrame:
    return snap_dump(edges, n, m, f"Generic random connected {_kind(directed, proper)}")


def small_world_file(edges: DataFrame, n: int, m: int, p: float, rewired: int, directed: bool = False, proper: bool = True) -> DataFrame:
    note = f"probability: {p:f}, number of rewird edges: {rewired} ({100 * rewired / m if m else 0:f}%)"
    return snap_dump(edges, n, m, f"Small-world connected {_kind(directed, proper)}", note)


def scale_free_file(edges: DataFrame, n: int, m: int, gamma: float, directed: bool = True) -> DataFrame:
    return snap_dump(edges, n, m, f"Scale-free connected {_kind(directed, True)}", f"gamma: {gamma:f}")


def dimacs9_file(graph: Graph, n: int, m: int, source: int = 0) -> DataFrame:
    """``p sp n m``, ``s source`` and an ``a u v w`` line for each edge, ids from 1."""
    body = graph.edges.select("src", F.format_string("a %d %d %d", F.col("src") + 1, F.col("dst") + 1, F.col("weight")).alias("value"))
    return _framed(body, ["c", f"p sp {n} {m}", f"s {source + 1}"], [], "src")


def metis_file(graph: Graph, n: int, m: int) -> DataFrame:
    """``n m`` and a line of neighbours, from 1, for each vertex; edges are given both ways and are ``m`` without direction."""
    near = graph.edges.groupBy(F.col("src").alias("s")).agg(F.sort_array(F.collect_list(F.col("dst") + 1)).alias("to"))
    body = graph.vertices.join(near, F.col("id") == F.col("s"), "left").select("id", F.coalesce(F.array_join(F.col("to").cast("array<string>"), " "), F.lit("")).alias("value"))
    return _framed(body, ["% neighbours", f"{n} {m}"], [], "id")


def weighted_file(edges: DataFrame, bracketed: bool = False) -> DataFrame:
    form = "(%d,%d,%d)" if bracketed else "%d %d %d"
    return _framed(edges.select("src", F.format_string(form, "src", "dst", "weight").alias("value")), ["# left right weight"], [], "src")


def table_dump(t1: DataFrame, t2: DataFrame) -> DataFrame:
    """Both tables ``key value``, each after its number of rows."""
    spark = t1.sparkSession
    out = spark.createDataFrame([(0, 0, 0, str(t1.count())), (2, 0, 0, str(t2.count()))], "part int, k long, v long, value string")
    for part, t in ((1, t1), (3, t2)):
        out = out.unionByName(t.select(F.lit(part).alias("part"), F.col("key").alias("k"), F.col("value").alias("v"), F.format_string("%d %d", "key", "value").alias("value")))
    return out.orderBy("part", "k", "v").select("value")


def vector_file(rows: DataFrame) -> DataFrame:
    """The number of trip counts, then one in each line."""
    return _framed(rows.select("idx", F.col("iter").cast("string").alias("value")), [str(rows.count())], [], "idx")


def stats_line(sizes: dict[str, int], seconds: dict[str, float]) -> str:
    """Sizes, then timings with four decimals, separated by tabs."""
    return "\t".join([*map(str, sizes.values()), *(f"{s:.4f}" for s in seconds.values())])


def tree_stats(spark: SparkSession, levels: int, degree: int, descendants: Callable[[str], DataFrame]) -> str:
    """Levels, out-degree, nodes and the seconds of each way to count descendants, as one line."""
    nodes, seconds = 0, {}
    for how in ("bottom_up", "ancestors"):
        began = time.perf_counter()
        nodes = descendants(how).count()
        seconds[how] = time.perf_counter() - began
    return stats_line({"levels": levels, "outdegree": degree, "num_nodes": nodes}, seconds)


def matrix_report(pairs: DataFrame, value: str) -> DataFrame:
    """A line for each ``src``: its ``value`` to every ``dst``, or 0, three places each. For few vertices: a line holds all of them."""
    ids = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct()
    row = pairs.groupBy(F.col("src").alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("dst", value))).alias("to"))
    every = ids.agg(F.sort_array(F.collect_list("id")).alias("all"))
    cells = F.transform("all", lambda c: F.format_string("%3d", F.coalesce(F.element_at("to", c), F.lit(0))))
    line = ids.join(row, F.col("id") == F.col("s"), "left").withColumn("all", F.lit(every.first()["all"]))
    return line.orderBy("id").select(F.concat(F.format_string("%d", "id"), F.array_join(cells, "")).alias("value"))


def bfs_report(vertices: DataFrame, levels: DataFrame, root: int) -> DataFrame:
    every = vertices.join(levels.select(F.col("id").alias("l_id"), "level"), F.col("id") == F.col("l_id"), "left")
    far = F.format_string("  Vertex %2d is disconnected from the root vertex.", "id")
    said = F.when(F.col("level").isNull(), far).otherwise(F.format_string("  Vertex %2d is of level %d.", "id", "level"))
    return _framed(every.select("id", said.alias("value")), [f"With vertex {root} as the root:"], [], "id")


def path_report(path: DataFrame) -> DataFrame:
    """The lines of a row ``path cost``, or that the vertices are not connected if there is no row."""
    lines = F.array(
        F.format_string("Minimum path weight is %d.", "cost"), F.concat(F.lit("Path: "), F.array_join(F.col("path").cast("array<string>"), " -> ")),
        F.lit("(There may be other paths of equal length.)"),
    )
    none = F.array(F.lit("Minimum path weight is infinite (vertices are disconnected)."))
    one = path.agg(F.max(F.struct("cost", "path")).alias("p")).select("p.*")
    return one.select(F.explode(F.when(F.col("cost").isNull(), none).otherwise(lines)).alias("value"))
