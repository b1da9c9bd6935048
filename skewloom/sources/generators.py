"""Seeded generators of graphs, trees, tables and trip counts. Output does not depend on partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skewloom.functions.uniform import integer, power_law, uniform
from skewloom.operators.graph import Graph
from skewloom.plans.ordering import numbered
from skewloom.session import Scratch


def _graph(spark: SparkSession, n: int, edges: DataFrame, proper: bool, seed: int) -> Graph:
    e = edges.where("src <> dst").select("src", "dst").distinct() if proper else edges.select("src", "dst")
    return Graph(spark.range(n).select("id"), e.withColumn("weight", integer(seed, 1, 1001, "src", "dst", stream=90)).withColumn("pos", F.xxhash64("src", "dst")))


def trip_counts(spark: SparkSession, n: int, low: int, high: int, k: float | None = None, seed: int = 1) -> DataFrame:
    """``idx iter data``: uniform, or a power law with exponent ``k``."""
    count = integer(seed, low, high, "id") if k is None else power_law(seed, low, high, k, "id")
    return spark.range(n).select(F.col("id").alias("idx"), count.cast("int").alias("iter"), uniform(seed, "id", stream=1).alias("data"))


def _union(a: DataFrame, b: DataFrame | None) -> DataFrame:
    return a if b is None else a.unionByName(b)


def _placed(scratch: Scratch, pending: DataFrame, taken: DataFrame | None, propose: Callable[[DataFrame, int], DataFrame], both_ways: bool = False, max_rounds: int = 200) -> DataFrame:
    """An edge ``src dst`` for each row ``src j`` of ``pending``: proposals that are loops or that exist are drawn anew.

    ``propose(pending, k)`` adds ``dst``. With ``both_ways`` an edge and its turned one are the same. Every round places at
    least the proposals that are new, so the rest shrinks as fast as free places are met.
    """
    pair = lambda df: df.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")) if both_ways else df.select("src", "dst")
    pending, n = scratch.counted(pending.select("src", "j"), "pending")
    done = None
    for k in range(max_rounds):
        if not n:
            break
        drawn = scratch.table(propose(pending, k).where("src <> dst"), f"drawn{k}")
        low, high = (F.least("src", "dst"), F.greatest("src", "dst")) if both_ways else (F.col("src"), F.col("dst"))
        keyed = drawn.select(F.col("src").alias("own"), "j", F.struct(low.alias("src"), high.alias("dst")).alias("e"))
        first = keyed.groupBy("e").agg(F.min(F.struct("own", "j")).alias("who")).select("e.*", "who")
        if taken is not None:
            known = pair(taken).select(F.col("src").alias("t_src"), F.col("dst").alias("t_dst"))
            first = first.join(known, (first["src"] == known["t_src"]) & (first["dst"] == known["t_dst"]), "left_anti")
        first = scratch.table(first, f"placed{k}")
        new = first.select(F.col("who.own").alias("src"), F.when(F.col("who.own") == F.col("src"), F.col("dst")).otherwise(F.col("src")).alias("dst"))
        done, taken = _union(new, done), _union(new, taken)
        who = first.select(F.col("who.own").alias("w_src"), F.col("who.j").alias("w_j"))
        pending, n = scratch.counted(pending.join(who, (pending["src"] == who["w_src"]) & (pending["j"] == who["w_j"]), "left_anti"), "pending")
    if n:
        raise ValueError(f"{n} edges found no place: the graph is too dense for a proper one")
    return done if done is not None else pending.select("src", F.col("j").cast("long").alias("dst"))


def _other(seed: int, n: int, stream: int) -> Callable[[DataFrame, int], DataFrame]:
    """Proposes any other vertex."""

    def propose(pending: DataFrame, k: int) -> DataFrame:
        to = integer(seed, 0, n - 1, "src", "j", stream=stream + k)
        return pending.withColumn("dst", to + (to >= F.col("src")).cast("long"))

    return propose


def _distinct(scratch: Scratch, n: int, need: DataFrame, taken: DataFrame | None, seed: int, stream: int) -> DataFrame:
    """Edges from each ``src`` to ``d`` distinct random other vertices that are not ``taken``.

    A vertex that wants more than a quarter of all ranks the others, at most four times as many rows as it gets; for the rest
    colliding draws are drawn anew.
    """
    dense = 4 * F.col("d") > n - 1
    pending = need.where(~dense & (F.col("d") > 0)).select("src", F.explode(F.sequence(F.lit(1), F.col("d").cast("int"))).alias("j"))
    sparse = _placed(scratch, pending, taken, _other(seed, n, stream))
    others = need.where(dense).select("src", "d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("dst")).where("src <> dst")
    if taken is not None:
        known = taken.select(F.col("src").alias("t_src"), F.col("dst").alias("t_dst"))
        others = others.join(known, (others["src"] == known["t_src"]) & (others["dst"] == known["t_dst"]), "left_anti")
    rank = Window.partitionBy("src").orderBy(uniform(seed, "src", "dst", stream=stream - 1), "dst")
    return sparse.unionByName(others.withColumn("r", F.row_number().over(rank)).where("r <= d").select("src", "dst"))


def degree_graph(spark: SparkSession, n: int, low: int, high: int, k: float | None = None, seed: int = 1) -> Graph:
    """Out-degrees by :func:`trip_counts`, at most ``n - 1``; distinct random neighbours other than the vertex itself."""
    d = trip_counts(spark, n, low, high, k, seed).select(F.col("idx").alias("src"), F.least("iter", F.lit(n - 1)).alias("d"))
    scratch = Scratch(spark, "degree-graph")
    return _graph(spark, n, _distinct(scratch, n, d, None, seed, 1000), False, seed)


def _tree(scratch: Scratch, spark: SparkSession, n: int, children: int, seed: int) -> DataFrame:
    """``src dst``: a spanning tree over the ids in random order, at most so many children each."""
    placed = scratch.table(numbered(scratch, spark.range(n).select("id", uniform(seed, "id", stream=3).alias("u")), [F.col("u"), F.col("id")], "p"), "order")
    up = placed.select(F.col("p").alias("up"), F.col("id").alias("src"))
    under = placed.where("p > 0").select(F.floor((F.col("p") - 1) / children).cast("long").alias("to"), F.col("id").alias("dst"))
    return scratch.table(under.join(up, under["to"] == up["up"]).select("src", "dst"), "tree")


def _wanted(spark: SparkSession, n: int, low: int, high: int, seed: int, have: DataFrame) -> DataFrame:
    """``src d``: how many edges a vertex still needs for a degree drawn from ``low`` to ``high``; ``have(id n)`` has their number so far."""
    d = spark.range(n).select(F.col("id").alias("src"), integer(seed, low, high + 1, "id", stream=4).alias("want"))
    return d.join(have, d["src"] == have["id"], "left").select("src", F.greatest(F.lit(0), F.col("want") - F.coalesce("n", F.lit(0))).alias("d"))


def random_directed(spark: SparkSession, n: int, low: int, high: int, proper: bool = True, seed: int = 1) -> Graph:
    """A random spanning tree, filled up to an out-degree drawn from ``low`` to ``high`` for each vertex (1 <= high < n)."""
    scratch = Scratch(spark, "directed")
    tree = _tree(scratch, spark, n, max(1, high // 2), seed)
    need = scratch.table(_wanted(spark, n, low, high, seed, tree.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))), "need")
    if proper:
        more = _distinct(scratch, n, need, tree, seed, 2000)
    else:
        more = need.where("d > 0").select("src", F.explode(F.sequence(F.lit(1), F.col("d").cast("int"))).alias("j")).select("src", integer(seed, 0, n, "src", "j", stream=5).alias("dst"))
    return _graph(spark, n, tree.unionByName(more), False, seed)


def random_undirected(spark: SparkSession, n: int, low: int, high: int, proper: bool = True, seed: int = 1, max_rounds: int = 40) -> Graph:
    """As :func:`random_directed`, the degree counted at both ends, and both directions of every edge (high >= 2).

    Open ends are shuffled and paired, round after round; no degree exceeds ``high``. The few ends that find no partner in
    ``max_rounds`` (an odd one, or ends of vertices that are joined already) stay open.
    """
    scratch = Scratch(spark, "undirected")
    made = _tree(scratch, spark, n, max(1, (high - 1) // 2), seed)
    for k in range(max_rounds):
        ends = made.select(F.col("src").alias("id")).unionByName(made.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("n"))
        open_ends = _wanted(spark, n, low, high, seed, ends).where("d > 0").select("src", F.explode(F.sequence(F.lit(1), F.col("d").cast("int"))).alias("j"))
        shuffled = scratch.table(numbered(scratch, open_ends.withColumn("u", uniform(seed, "src", "j", stream=3000 + k)), [F.col("u"), F.col("src"), F.col("j")], "p"), f"ends{k}")
        pair = shuffled.groupBy(F.floor(F.col("p") / 2).alias("pair")).agg(F.min("src").alias("src"), F.max("src").alias("dst"), F.count("*").alias("n")).where("n = 2")
        if proper:
            known = made.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
            pair = pair.where("src <> dst").select("src", "dst").distinct()
            pair = pair.join(known, (pair["src"] == known["a"]) & (pair["dst"] == known["b"]), "left_anti")
        new, found = scratch.counted(pair.select("src", "dst"), f"pairs{k}")
        if not found:
            break
        made = made.unionByName(new)
    return _graph(spark, n, made.unionByName(made.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), False, seed)


def ring(spark: SparkSession, n: int, degree: int) -> DataFrame:
    """``src dst``: every vertex to the next ``degree / 2`` round a ring."""
    return spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(max(1, degree // 2)))).alias("j")).select("src", F.pmod(F.col("src") + F.col("j"), F.lit(n)).alias("dst"))


def ring_lattice(spark: SparkSession, n: int, degree: int, seed: int = 1) -> Graph:
    return _graph(spark, n, ring(spark, n, degree), False, seed)


def small_world(spark: SparkSession, n: int, degree: int, p: float, proper: bool = True, seed: int = 1) -> Graph:
    """A ring lattice whose right ends are drawn anew with probability ``p``; no edge is lost.

    A ``proper`` graph has no loop and no edge twice, in either direction: such draws are repeated.
    """
    edges = ring(spark, n, degree).withColumn("redraw", uniform(seed, "src", "dst", stream=6) < p)
    if not proper:
        to = F.when(F.col("redraw"), integer(seed, 0, n, "src", "dst", stream=7)).otherwise(F.col("dst"))
        return _graph(spark, n, edges.select("src", to.alias("dst")), False, seed)
    scratch = Scratch(spark, "small-world")
    kept = edges.where("NOT redraw").select("src", "dst")
    return _graph(spark, n, kept.unionByName(_placed(scratch, edges.where("redraw").select("src", F.col("dst").alias("j")), kept, _other(seed, n, 4000), True)), False, seed)


def scale_free_degrees(n: int, gamma: float) -> list[tuple[int, int]]:
    """``degree, vertices``: ``n / degree^gamma`` vertices, rounded, of each degree from 2 on, and the rest of degree 1.

    With a small ``gamma``, for which that is more than all vertices, the lowest degrees come first.
    """
    want, left, degree = [], n, 2
    while degree < n and (c := min(left, math.floor(n / degree**gamma + 0.5))) > 0:
        want.append((degree, c))
        left, degree = left - c, degree + 1
    return [(1, left), *want] if left else want


def scale_free(spark: SparkSession, n: int, gamma: float, seed: int = 1) -> tuple[Graph, DataFrame]:
    """A connected graph of the out-degrees of :func:`scale_free_degrees`, and the report ``degree expected actual``.

    Vertices in descending order of their degree are the parents of those after them, one for each of their first ends,
    which makes a spanning tree; the other ends go to owners of random ends, so vertices of high degree are met more often.
    """
    scratch, want, starts, at = Scratch(spark, "scale-free"), scale_free_degrees(n, gamma), [], 0
    for d, c in reversed(want):
        starts.append((d, at, c))
        at += c
    bands = spark.createDataFrame(starts, "degree int, low long, count long")
    placed = numbered(scratch, spark.range(n).select("id", uniform(seed, "id", stream=9).alias("u")), [F.col("u"), F.col("id")], "p")
    # One row for each degree that occurs.
    owner = placed.join(F.broadcast(bands), (F.col("p") >= F.col("low")) & (F.col("p") < F.col("low") + F.col("count")))
    owner = scratch.table(owner.select(F.col("id").alias("src"), "p", "degree"), "owner")
    ends = owner.select("src", "p", F.explode(F.sequence(F.lit(1), F.col("degree"))).alias("j"))
    ends = scratch.table(numbered(scratch, ends, [F.col("p"), F.col("j")], "at").select("src", "j", "at"), "ends")
    total = sum(d * c for d, c in want)
    child = owner.where("p > 0").select((F.col("p") - 1).alias("slot"), F.col("src").alias("dst"))
    tree = scratch.table(ends.join(child, ends["at"] == child["slot"]).select("src", "dst"), "tree")
    meet = ends.select(F.col("at").alias("o"), F.col("src").alias("dst"))
    anyone = _other(seed, n, 6000)

    def propose(pending: DataFrame, k: int) -> DataFrame:
        if k >= 20:  # the hubs are full: the last ends go to anyone
            return anyone(pending, k)
        drawn = pending.withColumn("to", integer(seed, 0, total, "src", "j", stream=5000 + k))
        return drawn.join(meet, drawn["to"] == meet["o"]).select("src", "j", "dst")

    graph = _graph(spark, n, tree.unionByName(_placed(scratch, ends.where(F.col("at") >= n - 1).select("src", "j"), tree, propose)), False, seed)
    actual = graph.out_degree().groupBy(F.col("degree").alias("d")).agg(F.count("*").alias("actual"))
    wanted = spark.createDataFrame(want, "degree int, expected long")
    report = wanted.join(actual, F.col("degree") == F.col("d"), "full_outer").select(F.coalesce("degree", "d").cast("long").alias("degree"), F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return graph, report


def table_pair(spark: SparkSession, n1: int, n2: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Unique ascending keys from 1 in steps of 1 to 3, and keys drawn from their range; values 1..6666."""
    steps = spark.range(n1).select("id", integer(seed, 1, 4, "id").alias("step"))
    t1 = numbered(Scratch(spark, "pair"), steps, [F.col("id")], "before", F.col("step")).select((1 + F.col("before")).alias("key"), integer(seed, 1, 6667, "id", stream=1).alias("value"))
    top = t1.agg(F.max("key")).first()[0] or 1
    t2 = spark.range(n2).select(integer(seed, 1, top + 1, "id", stream=2).alias("key"), integer(seed, 1, 6667, "id", stream=3).alias("value"))
    return t1, t2


def regular_tree(spark: SparkSession, levels: int, degree: int) -> DataFrame:
    """``node parent level``: breadth-first ids, every inner node with ``degree`` children."""
    sizes = [degree**k for k in range(levels)]
    starts = [sum(sizes[:k]) for k in range(levels)]
    level: Column = F.lit(0)
    for k in range(1, levels):
        level = F.when(F.col("id") >= starts[k], k).otherwise(level) if k == 1 else F.greatest(level, F.when(F.col("id") >= starts[k], k).otherwise(0))
    return spark.range(sum(sizes)).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / degree).cast("long")).alias("parent"), level.alias("level"))


def random_tree(spark: SparkSession, min_height: int, max_height: int, min_degree: int, max_degree: int, possibility: int, seed: int = 0) -> DataFrame:
    """``node parent level``: in each level the first node has children and any other with probability 2^-possibility."""
    scratch = Scratch(spark, "tree")
    height = spark.range(1).select(integer(seed, min_height, max_height + 1, "id").alias("h")).first()["h"]
    front = scratch.table(spark.range(1).select(F.col("id").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("level")), "root")
    out, total = front, 1
    for k in range(1, int(height) + 1):
        first = front.agg(F.min("node")).first()[0]
        has = (F.col("node") == first) | (uniform(seed, "node", stream=1) < 2.0**-possibility)
        kids = front.where(has).select(F.col("node").alias("parent"), F.explode(F.sequence(F.lit(1), integer(seed, min_degree, max_degree + 1, "node", stream=2))).alias("j"))
        made = numbered(scratch, kids, [F.col("parent"), F.col("j")], "at")
        front = scratch.table(made.select((F.col("at") + total).alias("node"), "parent", F.lit(k).alias("level")), f"level{k}")
        total += front.count()
        out = out.unionByName(front)
    return out
