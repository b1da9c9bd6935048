"""Readers, reports, generators and the command line."""

import pytest

from skewloom import cli
from skewloom.operators import traversal
from skewloom.sources import generators as gen
from skewloom.sources import readers, reports

DIMACS9 = "c tiny\np sp 4 5\ns 1\na 1 2 7\na 1 3 3\na 3 2 1\na 2 4 2\na 3 4 9\n"
DIMACS10 = "% tiny\n4 4\n2 3\n1 3\n1 2 4\n3\n"
SNAP = "# Directed graph: tiny\n# comment\n# Nodes: 4 Edges: 5\n# FromNodeId ToNodeId\n10 20\n10 30\n30 20\n20 77\n30 77\n"


def put(tmp_path, text):
    p = tmp_path / "in.txt"
    p.write_text(text)
    return str(p)


def pairs(g):
    return sorted((r.src, r.dst) for r in g.edges.collect())


def test_dimacs9(spark, tmp_path):
    x = readers.read_dimacs9(spark, put(tmp_path, DIMACS9))
    assert (x.n, x.m, x.source) == (4, 5, 0)
    assert {r.id: r.cost for r in traversal.sssp(x.graph, x.source).collect()} == {0: 0, 1: 4, 2: 3, 3: 6}
    assert {r.id: r.level for r in traversal.bfs(x.graph, 0).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}


def test_dimacs10_with_isolated_vertex(spark, tmp_path):
    x = readers.read_dimacs10(spark, put(tmp_path, DIMACS10))
    assert {r.id: r.color for r in traversal.coloring(x.graph).collect()} == {0: 1, 1: 2, 2: 3, 3: 4}
    assert x.m == 8 and all(1 <= r.weight <= 1000 for r in x.graph.edges.collect())
    y = readers.read_dimacs10(spark, put(tmp_path, "3 1\n3\n\n1\n"))
    assert pairs(y.graph) == [(0, 2), (2, 0)]


def test_snap(spark, tmp_path):
    x = readers.read_snap(spark, put(tmp_path, SNAP))
    assert (x.n, x.m) == (4, 5) and pairs(x.graph) == [(0, 1), (0, 2), (1, 3), (2, 1), (2, 3)]


def test_weighted(spark, tmp_path):
    x = readers.read_weighted(spark, put(tmp_path, "# head\n1 2 5\n(2,3,7)\n"))
    assert sorted((r.src, r.dst, r.weight) for r in x.graph.edges.collect()) == [(1, 2, 5), (2, 3, 7)]


def saved(df, tmp_path, name="out"):
    where = str(tmp_path / name)
    df.coalesce(1).write.text(where)
    return where


def test_round_trips(spark, tmp_path):
    t1, t2 = gen.table_pair(spark, 20, 30, seed=3)
    a, b = readers.read_table_pair(spark, saved(reports.table_dump(t1, t2), tmp_path))
    assert sorted(a.collect()) == sorted(t1.collect()) and sorted(b.collect()) == sorted(t2.collect())
    v = gen.trip_counts(spark, 40, 1, 9)
    got = readers.read_vector(spark, saved(reports.vector_file(v), tmp_path, "v"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, v.select("idx", "iter").collect()))
    g = gen.random_directed(spark, 12, 1, 3)
    x = readers.read_snap(spark, saved(reports.snap_dump(g.edges, 12, g.edges.count()), tmp_path, "g"))
    assert pairs(x.graph) == pairs(g)


def test_lines_are_numbered_where_they_are(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = [f"{f} {'x' * (k % 40)} {k}" for f in "ab" for k in range(400)]
    for f in "ab":
        (tmp_path / "in" / f).write_text("\n".join(x for x in want if x[0] == f) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in (("spark.sql.files.maxPartitionBytes", "900"), ("spark.sql.files.openCostInBytes", "1")):
            spark.conf.set(k, v)
        rows = readers.lines(spark, str(tmp_path / "in"))
        assert [r.value for r in sorted(rows.collect())] == want and sorted(r.line for r in rows.collect()) == list(range(800))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan and "Sort" not in plan
    assert readers.lines(spark, put(tmp_path, "")).count() == 0


def test_reports(spark):
    v = spark.range(2).select("id")
    lines = lambda df: [r.value for r in df.collect()]
    levels, costs = spark.createDataFrame([(0, 0)], "id long, level int"), spark.createDataFrame([(1, 8)], "id long, cost long")
    assert lines(reports.level_report(v, levels)) == ["Node 1 is in level 0", "Node 2 is in level 9999"]
    assert lines(reports.cost_report(v, costs, 0)) == ["From Node 1 -> 1 is 1073741824", "From Node 1 -> 2 is 8"]
    assert lines(reports.rank_report(v.selectExpr("id", "0.5D AS rank")))[0] == "Node 1: 0.5000000000"
    assert lines(reports.bc_report(v.selectExpr("id", "0.5D AS bc")))[0] == "Node 1: 0.500000"
    assert lines(reports.color_report(v.selectExpr("id", "3 AS color")))[1] == "Node 2: 3"
    assert lines(reports.dot_tree(gen.regular_tree(spark, 2, 2))) == ["digraph G {", "  0 -> 1;", "  0 -> 2;", "}"]
    assert lines(reports.vector_dump(v.selectExpr("id", "id + 0.5D AS y"), "id", "y", "y")) == ["y[0] = 0.5", "y[1] = 1.5"]
    assert reports.stats_line({"levels": 1}, {"it": 2.5}) == "1\t2.5000"
    assert lines(reports.path_report(spark.createDataFrame([], "path array<long>, cost long"))) == ["Minimum path weight is infinite (vertices are disconnected)."]
    assert lines(reports.matrix_report(spark.createDataFrame([(0, 1, 12), (1, 0, 3)], "src long, dst long, n long"), "n")) == ["0  0 12", "1  3  0"]


@pytest.mark.parametrize("make", [lambda s: gen.degree_graph(s, 30, 1, 6), lambda s: gen.random_directed(s, 30, 1, 4), lambda s: gen.random_undirected(s, 30, 2, 4), lambda s: gen.small_world(s, 30, 4, 0.2), lambda s: gen.scale_free(s, 30, 2.0)[0]])
def test_generated_graphs(spark, make):
    first = pairs(make(spark))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert pairs(make(spark)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert first and len(set(first)) == len(first) and all(a != b and 0 <= a < 30 and 0 <= b < 30 for a, b in first)


def test_generated_shapes(spark):
    assert pairs(gen.ring_lattice(spark, 5, 4)) == sorted((k, (k + s) % 5) for k in range(5) for s in (1, 2))
    t = gen.regular_tree(spark, 3, 2).orderBy("node").collect()
    assert [(r.node, r.parent, r.level) for r in t] == [(0, None, 0), (1, 0, 1), (2, 0, 1), (3, 1, 2), (4, 1, 2), (5, 2, 2), (6, 2, 2)]
    r = gen.random_tree(spark, 2, 4, 1, 3, 1).collect()
    assert {x.parent for x in r if x.level} <= {x.node for x in r} and 2 <= max(x.level for x in r) <= 4
    v = gen.trip_counts(spark, 500, 1, 50, -2.0).collect()
    assert all(1 <= x.iter <= 50 for x in v) and sum(x.iter <= 3 for x in v) > 250
    keys = [x.key for x in gen.table_pair(spark, 50, 5)[0].orderBy("key").collect()]
    assert keys[0] == 1 and all(1 <= b - a <= 3 for a, b in zip(keys, keys[1:], strict=False))


def test_degree_laws(spark):
    out = lambda g: {r.id: r.degree for r in g.out_degree().collect()}
    want = {r.idx: min(r.iter, 29) for r in gen.trip_counts(spark, 30, 1, 40, seed=3).collect()}
    dense = gen.degree_graph(spark, 30, 1, 40, seed=3)
    assert out(dense) == want and len(set(pairs(dense))) == sum(want.values())
    assert set(out(gen.random_directed(spark, 40, 2, 5)).values()) <= {2, 3, 4, 5}
    g = gen.random_undirected(spark, 40, 3, 5)
    d = list(out(g).values())
    assert max(d) <= 5 and sum(x < 3 for x in d) <= 2 and len(traversal.bfs(g, 0).collect()) == 40
    w = gen.small_world(spark, 30, 6, 0.5)
    p = pairs(w)
    assert len({frozenset(x) for x in p}) == len(p) == 90 and any((b - a) % 30 > 3 for a, b in p)
    f, report = gen.scale_free(spark, 60, 1.8)
    assert all(r.expected == r.actual for r in report.collect()) and report.count() > 3 and len(traversal.bfs(f.symmetrize(), 0).collect()) == 60
    assert len(set(pairs(f))) == len(pairs(f)) and sum(c for _, c in gen.scale_free_degrees(60, 1.8)) == 60


def test_small_world_trials(spark):
    from skewloom.operators import metrics

    got = metrics.small_world_trials(spark, 20, 4, 0.3, trials=2, seed=5).collect()
    assert sorted(r.trial for r in got) == [1, 2] and all(r.rewired > 0 and r.path_ratio < 1 and r.cluster_ratio < 1 for r in got)
    still = metrics.small_world_trials(spark, 20, 4, 0.0, trials=1).first()
    assert (still.rewired, still.path_ratio, still.cluster_ratio) == (0, 1.0, 1.0)


def test_command_line(spark, tmp_path):
    assert cli.main(["sssp", "--import", put(tmp_path, DIMACS9), "--out", str(tmp_path / "r"), "--strategy", "salt"]) == 0
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect())[1] == "From Node 1 -> 2 is 4"
    assert cli.main(["generate", "--what", "table-pair", "--numbers", "5", "7", "--out", str(tmp_path / "t")]) == 0
    assert cli.main(["join", "--import", str(tmp_path / "t"), "--out", str(tmp_path / "j")]) == 0
    assert spark.read.json(str(tmp_path / "j")).count() <= 7
    assert cli.main(["generate", "--what", "small-world", "--numbers", "20", "4", "0.2", "--out", str(tmp_path / "w")]) == 0
    assert cli.main(["degree", "--format", "2", "--import", str(tmp_path / "w")]) == 0


def test_streaming_degrees(spark, tmp_path):
    from skewloom.streaming.degrees import edge_stream, running_degrees

    spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src long, dst long").write.parquet(str(tmp_path / "e"))
    q = running_degrees(edge_stream(spark, str(tmp_path / "e"))).writeStream.format("memory").queryName("deg").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.id: r.degree for r in spark.sql("SELECT * FROM deg").collect()} == {1: 2, 2: 1}
