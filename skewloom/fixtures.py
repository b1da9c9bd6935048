"""Graphs, trees and vectors that derive from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.graph import Graph
from .session import read_table


def g_orders(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, with an edge from the customer of each order to that of the next order."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    a = o.select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("src"))
    b = o.select((F.col("o_orderkey") - 1).alias("prev"), F.col("o_custkey").alias("dst"))
    weight = (1 + F.pmod(F.col("pos") * 7919, F.lit(1000))).cast("long")
    edges = a.join(b, a["pos"] == b["prev"]).select("src", "dst", weight.alias("weight"), "pos")
    return Graph(read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), edges)


#: Lines that one task joins with their orders. Sorted keys shrink so much that sizes in bytes would join far too many.
TASK_ROWS = 2_000_000


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``l_orderkey l_suppkey``; many lines are dealt by order to tasks of bounded rows."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    rows = li.count()
    return li if rows <= TASK_ROWS else li.repartition(max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), "l_orderkey")


def g_trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers as in :func:`g_orders`, and suppliers after them, with an edge from the customer of each line to its supplier.

    Suppliers have no out-edge.
    """
    g, n = g_orders(spark, sf_dir), read_table(spark, sf_dir, "customer").count()
    o, li = read_table(spark, sf_dir, "orders"), _lines(spark, sf_dir)
    sold = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + n).alias("dst"))
    suppliers = read_table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + n).alias("id"))
    return Graph(g.vertices.unionByName(suppliers), g.edges.select("src", "dst").unionByName(sold))


def g_supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers, each with three edges: to the next one, to one by its number, to one by its nation. For measures over all pairs."""
    s = read_table(spark, sf_dir, "supplier")
    n = F.lit(s.count())
    k = F.col("s_suppkey")
    ends = F.posexplode(F.array((k + 1) % n, (7 * k + 3) % n, (k + F.col("s_nationkey") + 2) % n))
    edges = s.select(k.alias("src"), F.col("s_nationkey"), ends.alias("j", "dst"))
    edges = edges.select("src", "dst", (1 + F.col("s_nationkey") + F.col("j")).cast("long").alias("weight"), (3 * F.col("src") + F.col("j")).alias("pos"))
    return Graph(s.select(k.alias("id")), edges)


def both_ways(graph: Graph) -> Graph:
    """Every edge in both directions with its weight, without loops; parallel edges stay."""
    e = graph.edges.where("src <> dst").select("src", "dst", "weight")
    return Graph(graph.vertices, e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))


def t_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a tree in which each node has four children."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    return c.select("node", F.when(F.col("node") > 0, F.floor((F.col("node") - 1) / 4).cast("long")).alias("parent"))


def j_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, li = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")), li.select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("value"))


def w_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``idx iter data``: an order's whole quantity as trips, its price as data."""
    li = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("int")).cast("int").alias("iter"))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("data"))
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("l_orderkey").alias("idx"), "iter", "data")
