"""Readers of text interchange formats. Every reader is a plan over ``spark.read.text``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skewloom.functions.uniform import integer
from skewloom.operators.graph import Graph
from skewloom.plans.ordering import numbered
from skewloom.session import Scratch

#: Seed of the weights of formats that have none.
WEIGHT_SEED = 7


@dataclass
class Loaded:
    graph: Graph
    n: int
    m: int
    source: int = 0


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``line value``: the lines of a file with their number from 0.

    Row ids are consecutive inside a split, and splits of a file begin at growing offsets, so a line's number is its id and a number
    of its split: lines are neither moved nor sorted.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    kept = Scratch(spark, "lines").table(raw, "raw")
    total, shifts = 0, []
    for s in sorted(kept.groupBy("f", "at").agg(F.min("k").alias("first"), F.count("*").alias("n")).collect()):
        shifts.append((s["f"], s["at"], total - s["first"]))
        total += s["n"]
    shift = F.broadcast(spark.createDataFrame(shifts, "s_f string, s_at long, shift long"))
    return kept.join(shift, (F.col("f") == F.col("s_f")) & (F.col("at") == F.col("s_at"))).select((F.col("k") + F.col("shift")).alias("line"), "value")


def _fields() -> Column:
    return F.split(F.trim("value"), r"\s+")


def _weight(*keys: str) -> Column:
    return integer(WEIGHT_SEED, 1, 1001, *keys)


def read_dimacs9(spark: SparkSession, path: str) -> Loaded:
    """``c`` comment, ``p sp n m``, ``s source``, ``a u v w``; ids are from 1 in the file and from 0 here."""
    rows = lines(spark, path).withColumn("f", _fields())
    head = {r["f"][0]: r["f"] for r in rows.where(F.get("f", F.lit(0)).isin("p", "s")).select("f").collect()}
    n, m = int(head["p"][2]), int(head["p"][3])
    edges = rows.where(F.get("f", F.lit(0)) == "a").select(
        (F.get("f", F.lit(1)).cast("long") - 1).alias("src"), (F.get("f", F.lit(2)).cast("long") - 1).alias("dst"),
        F.get("f", F.lit(3)).cast("long").alias("weight"), F.col("line").alias("pos"),
    )
    return Loaded(Graph(spark.range(n).select("id"), edges), n, m, int(head["s"][1]) - 1 if "s" in head else 0)


def read_dimacs10(spark: SparkSession, path: str) -> Loaded:
    """``%`` comments, ``n m``, then the neighbours of each vertex in a line; weights are drawn from 1..1000."""
    rows = lines(spark, path).where(~F.col("value").startswith("%"))
    first = rows.orderBy("line").first()
    n, m = (int(x) for x in first["value"].split()[:2])
    body = numbered(Scratch(spark, "metis"), rows.where(F.col("line") > first["line"]), [F.col("line")], "src")
    near = body.where(F.trim("value") != "").select("src", F.posexplode(_fields()).alias("k", "to"))
    edges = near.select("src", (F.col("to").cast("long") - 1).alias("dst"), _weight("src", "k").alias("weight"), (F.col("src") * (1 << 32) + F.col("k")).alias("pos"))
    return Loaded(Graph(spark.range(n).select("id"), edges), n, 2 * m)


def read_snap(spark: SparkSession, path: str) -> Loaded:
    """Four header lines, the third ``# Nodes: N Edges: M``, then ``src dst``; ids are compacted in ascending order.

    Edges are counted anew. Weights are drawn from 1..1000.
    """
    rows = lines(spark, path)
    e = rows.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", _fields())
    edges = e.select(F.get("f", F.lit(0)).cast("long").alias("src"), F.get("f", F.lit(1)).cast("long").alias("dst"), F.col("line").alias("pos")).withColumn("weight", _weight("pos"))
    graph, ids = Graph(None, edges).compact_ids(Scratch(spark, "snap"))
    return Loaded(graph, ids.count(), edges.count())


def read_weighted(spark: SparkSession, path: str) -> Loaded:
    """Header lines that begin with ``#``, then ``left right weight`` or ``(left,right,weight)``; ids stay."""
    rows = lines(spark, path).where(~F.col("value").startswith("#"))
    f = F.regexp_extract_all("value", F.lit(r"-?\d+"), F.lit(0))
    e = rows.withColumn("f", f).where(F.size("f") >= 3)
    edges = e.select(*[F.get("f", F.lit(k)).cast("long").alias(c) for k, c in enumerate(("src", "dst", "weight"))], F.col("line").alias("pos"))
    g = Graph.from_edges(edges)
    return Loaded(g, g.vertices.count(), edges.count())


def read_table_pair(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``n1``, n1 lines ``key value``, ``n2``, n2 lines: two tables ``key value``."""
    rows = lines(spark, path)
    n1 = int(rows.where("line = 0").first()["value"])
    f = _fields()
    pick = lambda low, high: rows.where((F.col("line") > low) & (F.col("line") <= high)).select(F.get(f, F.lit(0)).cast("long").alias("key"), F.get(f, F.lit(1)).cast("long").alias("value"))
    n2 = int(rows.where(F.col("line") == n1 + 1).first()["value"])
    return pick(0, n1), pick(n1 + 1, n1 + 1 + n2)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """``n``, then n whole numbers over any lines: ``idx iter``."""
    words = lines(spark, path).where(F.trim("value") != "").select("line", F.posexplode(_fields()).alias("k", "w"))
    placed = numbered(Scratch(spark, "vector"), words, [F.col("line"), F.col("k")], "at")
    return placed.where("at > 0").select((F.col("at") - 1).alias("idx"), F.col("w").cast("int").alias("iter"))


READERS = {0: read_dimacs9, 1: read_dimacs10, 2: read_snap}
