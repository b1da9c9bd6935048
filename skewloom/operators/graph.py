"""A directed multigraph as two DataFrames, and its format conversions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewloom.plans.ordering import numbered
from skewloom.session import Scratch


@dataclass
class Graph:
    """``vertices(id)`` and ``edges(src, dst, weight, pos)``; parallel edges and loops are kept."""

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def from_edges(edges: DataFrame) -> Graph:
        ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
        return Graph(ids.distinct(), edges)

    def out_degree(self) -> DataFrame:
        """``id degree`` for every vertex, zero included."""
        d = self.edges.groupBy(F.col("src").alias("s")).agg(F.count("*").alias("n"))
        return self.vertices.join(d, self.vertices["id"] == d["s"], "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))

    def invert(self) -> Graph:
        other = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *other))

    def symmetrize(self) -> Graph:
        """Both directions of every edge, distinct, without loops."""
        e = self.edges.where("src <> dst").select("src", "dst")
        return Graph(self.vertices, e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())

    def dangling(self) -> DataFrame:
        """Vertices without an out-edge."""
        sources = self.edges.select("src").distinct()
        return self.vertices.join(sources, self.vertices["id"] == sources["src"], "left_anti")

    def multiplicity(self) -> DataFrame:
        """``src dst n``: parallel edges as counts."""
        return self.edges.groupBy("src", "dst").agg(F.count("*").alias("n"))

    def csr_positions(self, scratch: Scratch) -> DataFrame:
        """Edges with ``i``, their place in row-compressed order: by source, last read first."""
        return numbered(scratch, self.edges, [F.col("src"), F.col("pos").desc()], "i")

    def row_offsets(self, scratch: Scratch) -> DataFrame:
        """``id degree offset``: where each row begins in row-compressed order."""
        return numbered(scratch, self.out_degree(), [F.col("id")], "offset", F.col("degree"))

    def compact_ids(self, scratch: Scratch) -> tuple[Graph, DataFrame]:
        """Ids 0..k-1 in ascending order of those that touch an edge, and the map ``old id``."""
        used = Graph.from_edges(self.edges).vertices.select(F.col("id").alias("old"))
        ids = scratch.table(numbered(scratch, used, [F.col("old")], "id"), "ids")
        a, b = ids.select(F.col("old").alias("o1"), F.col("id").alias("i1")), ids.select(F.col("old").alias("o2"), F.col("id").alias("i2"))
        e = self.edges.join(a, F.col("src") == F.col("o1")).join(b, F.col("dst") == F.col("o2"))
        other = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(ids.select("id"), e.select(F.col("i1").alias("src"), F.col("i2").alias("dst"), *other)), ids
