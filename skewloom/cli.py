"""Command line: one sub-command for each analysis.

    python -m skewloom.cli bfs --format 1 --import graph.metis --strategy salt --out levels
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import linear, metrics, tables, traversal, trees
from .plans.skew import STRATEGIES
from .session import Scratch, build_session
from .sources import generators, readers, reports


def _analyse(args: argparse.Namespace, g: readers.Loaded) -> DataFrame:
    v = g.graph.vertices
    source = g.source if args.source is None else args.source
    if args.app == "bfs":
        return reports.level_report(v, traversal.bfs(g.graph, source, args.strategy))
    if args.app == "sssp":
        return reports.cost_report(v, traversal.sssp(g.graph, source, args.strategy), source)
    if args.app == "bc":
        return reports.bc_report(traversal.betweenness(g.graph, strategy=args.strategy))
    if args.app == "pagerank":
        return reports.rank_report(linear.pagerank(g.graph, strategy=args.strategy))
    if args.app == "color":
        return reports.color_report(traversal.coloring(g.graph, args.strategy))
    if args.app == "spmv":
        matrix, vector = linear.synthetic_matrix(Scratch(v.sparkSession, "spmv"), g.graph)
        return reports.vector_dump(linear.spmv(matrix, vector, v, args.strategy), "id", "y", "y")
    if args.app == "walks":
        return linear.walks(g.graph, 2)
    if args.app == "clustering":
        return metrics.clustering(g.graph)
    return metrics.degree_stats(g.graph)


def _generate(spark: SparkSession, what: str, n: list[float]) -> DataFrame:
    """A generator by its name and numbers, as a file of its format."""
    k = [int(x) for x in n]
    if what == "table-pair":
        return reports.table_dump(*generators.table_pair(spark, *k))
    if what == "trip-counts":
        return reports.vector_file(generators.trip_counts(spark, *k[:3], *n[3:]))
    if what in ("regular-tree", "random-tree"):
        return reports.dot_tree(getattr(generators, what.replace("-", "_"))(spark, *k))
    if what == "scale-free":
        g = generators.scale_free(spark, k[0], n[1])[0]
        return reports.scale_free_file(g.edges, k[0], g.edges.count(), n[1])
    if what == "small-world":
        g = generators.small_world(spark, k[0], k[1], n[2])
        near = (F.pmod(F.col("dst") - F.col("src"), F.lit(k[0])) <= k[1] // 2) & (F.col("dst") != F.col("src"))
        return reports.small_world_file(g.edges, k[0], g.edges.count(), n[2], g.edges.where(~near).count())
    make = {"degree-graph": generators.degree_graph, "random-directed": generators.random_directed, "random-undirected": generators.random_undirected}[what]
    g = make(spark, *k[:3])
    return reports.random_graph_file(g.edges, k[0], g.edges.count(), what != "random-undirected")


GENERATORS = ("degree-graph", "random-directed", "random-undirected", "small-world", "scale-free", "table-pair", "trip-counts", "regular-tree", "random-tree")


def _other(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.app == "generate":
        return _generate(spark, args.what, args.numbers)
    if args.app == "tree":
        made = generators.regular_tree(spark, int(args.numbers[0]), int(args.numbers[1]))
        return reports.vector_dump(trees.descendants(made), "node", "descendants", "descendants")
    if args.app == "join":
        return tables.inner_join(*readers.read_table_pair(spark, args.path), strategy=args.strategy)
    if args.app == "np":
        rows = readers.read_vector(spark, args.path).withColumn("data", F.col("idx").cast("double"))
        return reports.vector_dump(tables.nested_work(rows, strategy=args.strategy), "idx", "rst", "rst")
    n, degree, p, trials = args.numbers
    return metrics.small_world_trials(spark, int(n), int(degree), p, int(trials))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="skewloom")
    p.add_argument("app", choices=("bfs", "sssp", "bc", "pagerank", "color", "spmv", "degree", "walks", "clustering", "tree", "join", "np", "trials", "generate"))
    p.add_argument("--format", type=int, choices=sorted(readers.READERS), default=0, help="0 DIMACS9, 1 DIMACS10, 2 SNAP")
    p.add_argument("--import", dest="path")
    p.add_argument("--source", type=int)
    p.add_argument("--strategy", choices=STRATEGIES, default="auto")
    p.add_argument("--what", choices=GENERATORS, help="what to generate")
    p.add_argument("--numbers", type=float, nargs="*", default=[], help="parameters of a generator, a tree (levels degree) or trials (n degree p trials)")
    p.add_argument("--out", help="folder for the report; without it the first lines are shown")
    args = p.parse_args(argv)
    spark = build_session()
    out = _other(spark, args) if args.app in ("tree", "join", "np", "trials", "generate") else _analyse(args, readers.READERS[args.format](spark, args.path))
    if args.out:
        (out.write.text if out.columns == ["value"] else out.write.json)(args.out)
    else:
        out.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
