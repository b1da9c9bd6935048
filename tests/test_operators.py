"""Operators against sequential Python on small graphs, and their invariants."""

import heapq
import random
import re
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewloom.operators import linear, metrics, pairs, tables, traversal, trees
from skewloom.operators.graph import Graph
from skewloom.plans import fixpoint, skew
from skewloom.plans.ordering import numbered
from skewloom.plans.skew import STRATEGIES
from skewloom.session import Scratch


@pytest.fixture(scope="module")
def edges():
    r = random.Random(5)
    # A hub with many edges, parallel edges, loops, an isolated vertex and a dead end.
    e = [(r.randrange(14), r.randrange(14), r.randint(1, 9)) for _ in range(40)] + [(0, k, 5) for k in range(12)] + [(3, 3, 1), (1, 2, 4), (1, 2, 4), (5, 15, 2)]
    return [(a, b, w, k) for k, (a, b, w) in enumerate(e)]


@pytest.fixture(scope="module")
def graph(spark, edges):
    return Graph(spark.range(17).select("id"), spark.createDataFrame(edges, "src long, dst long, weight long, pos long"))


def hops(edges, s):
    level, todo = {s: 0}, deque([s])
    while todo:
        v = todo.popleft()
        for a, b, *_ in edges:
            if a == v and b not in level:
                level[b] = level[v] + 1
                todo.append(b)
    return level


def dijkstra(edges, s):
    cost, todo = {}, [(0, s)]
    while todo:
        c, v = heapq.heappop(todo)
        if v not in cost:
            cost[v] = c
            for a, b, w, _ in edges:
                if a == v:
                    heapq.heappush(todo, (c + w, b))
    return cost


def brandes(edges, n):
    bc = [0.0] * n
    for s in range(n):
        level = hops(edges, s)
        sigma = {v: 0.0 for v in level} | {s: 1.0}
        order = sorted(level, key=level.get)
        for v in order:
            for a, b, *_ in edges:
                if a == v and level[b] == level[v] + 1:
                    sigma[b] += sigma[v]
        delta = dict.fromkeys(level, 0.0)
        for v in reversed(order):
            for a, b, *_ in edges:
                if a == v and level[b] == level[v] + 1:
                    delta[v] += sigma[v] / sigma[b] * (1 + delta[b])
            if v != s:
                bc[v] += delta[v]
    return bc


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_bfs_and_sssp(graph, edges, strategy):
    assert {r.id: r.level for r in traversal.bfs(graph, 0, strategy).collect()} == hops(edges, 0)
    assert {r.id: r.cost for r in traversal.sssp(graph, 0, strategy).collect()} == dijkstra(edges, 0)


def test_bfs_of_a_long_path(spark):
    path = spark.range(39).selectExpr("id AS src", "id + 1 AS dst", "1L AS weight", "id AS pos")
    g = Graph.from_edges(path)
    assert {r.id: r.level for r in traversal.bfs(g, 0).collect()} == {k: k for k in range(40)}


def test_shortest_path(graph, edges):
    want = dijkstra(edges, 0)
    got = traversal.shortest_path(graph, 0, 15).first()
    best = {}
    for a, b, w, _ in edges:
        best[a, b] = min(w, best.get((a, b), w))
    assert got.cost == want[15] == sum(best[x] for x in zip(got.path, got.path[1:], strict=False))
    assert traversal.shortest_path(graph, 0, 16).count() == 0


def test_betweenness(graph, edges):
    want = brandes(edges, 17)
    got = {r.id: r.bc for r in traversal.betweenness(graph).collect()}
    assert got == pytest.approx(dict(enumerate(want)))


def no_pairs(*_):
    raise AssertionError("a table of all pairs")


def test_betweenness_without_a_table_of_pairs(spark, monkeypatch):
    r = random.Random(8)
    e = [(k, (k + 1) % 90, 1, k) for k in range(90)] + [(r.randrange(90), r.randrange(90), 1, 90 + k) for k in range(120)] + [(4, 9, 1, 210), (4, 9, 1, 211)]
    g = Graph(spark.range(91).select("id"), spark.createDataFrame(e, "src long, dst long, weight long, pos long"))
    monkeypatch.setattr(traversal, "all_levels", no_pairs)
    monkeypatch.setattr(pairs, "TASKS_A_CORE", 1)
    want = brandes(e, 91)
    for strategy in STRATEGIES:
        assert {x.id: x.bc for x in traversal.betweenness(g, strategy=strategy).collect()} == pytest.approx(dict(enumerate(want)))


def test_path_length_without_a_table_of_pairs(spark, monkeypatch):
    r = random.Random(8)
    e = [(k, (k + 1) % 90) for k in range(90)] + [(r.randrange(90), r.randrange(90)) for k in range(120)]
    edges = spark.createDataFrame(e, "src long, dst long")
    far = [hops(e, s) for s in range(90)]
    monkeypatch.setattr(metrics, "all_levels", no_pairs)
    found = metrics.characteristic_path_length(Graph(spark.range(90).select("id"), edges)).first().path_length
    assert found == pytest.approx(sum(sum(f.values()) for f in far) / (90 * 89))
    assert metrics.characteristic_path_length(Graph(spark.range(91).select("id"), edges)).first().path_length is None


def test_walks_over_several_sources(monkeypatch):
    r = random.Random(9)
    e = sorted((r.randrange(200), r.randrange(200), 1) for _ in range(500))
    src, dst = (np.array([x[k] for x in e]) for k in (0, 1))
    rows = pairs.Rows(np.arange(200), src, dst, np.ones(500))
    monkeypatch.setattr(pairs, "WALK_PLACES", 2100)  # three sources at once
    monkeypatch.setattr(pairs, "WALK_WORDS", 1)  # 64
    far = [hops(e, s) for s in range(200)]
    for walk, want in ((pairs._walk_dependencies, [brandes(e, 200)]), (pairs._walk_hops, [[sum(f.get(v, 0) for f in far) for v in range(200)], [sum(f.get(v, 0) > 0 for f in far) for v in range(200)]])):
        add, done = walk(rows)
        for at in np.split(np.arange(200), [7, 140]):
            add(at)
        assert [list(x) for x in done()] == [pytest.approx(w) for w in want]


def test_all_pairs_of_a_graph_too_large_to_send(graph, edges, monkeypatch):
    monkeypatch.setattr(pairs, "FITS", 3)
    monkeypatch.setattr(pairs, "_from_sources", no_pairs)
    want = brandes(edges, 17)
    for strategy in ("auto", "salt"):
        assert {r.id: r.bc for r in traversal.betweenness(graph, strategy=strategy).collect()} == pytest.approx(dict(enumerate(want)))
    assert metrics.characteristic_path_length(graph).first().path_length is None


@pytest.mark.parametrize("strategy", ("auto", "salt", "degree_split"))
def test_edges_of_a_loop_stay_where_they_are(spark, graph, monkeypatch, strategy):
    edges = graph.edges.select("src", "dst")
    want = sorted(map(tuple, edges.collect()))
    monkeypatch.setattr(skew, "BUCKET_FROM", 1)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scratch = Scratch(spark, "stay")
        kept = skew.Gather(scratch, edges, "src", strategy)
        if strategy == "salt":
            kept = skew.Gather(scratch, edges, "src", strategy, 100)  # no hot key
        met = kept.join(graph.vertices.select(F.col("id").alias("v")), "v", 17)
        assert sorted((r.src, r.dst) for r in met.collect()) == want
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Exchange hashpartitioning(src" not in plan
        tables = {t.name for t in spark.catalog.listTables() if t.name.startswith("by_key")}
        scratch.finish(spark.range(1))
        assert tables and not tables & {t.name for t in spark.catalog.listTables()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    monkeypatch.setattr(skew, "BUCKET_KEY_ROWS", 2)  # the hub has more
    assert skew._by_key(scratch, edges, ["src"]) is None


def test_pagerank_rounds_leave_out_edges_to_dead_ends(spark, monkeypatch):
    joined = []
    monkeypatch.setattr(linear, "Gather", lambda scratch, many, *a: joined.append(sorted((r.src, r.dst) for r in many.collect())) or skew.Gather(scratch, many, *a))
    e = [(0, 1), (1, 0), (0, 2), (0, 2), (1, 3), (0, 9)]  # 9 is no vertex
    g = Graph(spark.range(5).select("id"), spark.createDataFrame(e, "src long, dst long"))
    for rounds in (0, 1, 2, 7):
        rank = [200.0] * 5
        for _ in range(rounds):
            lost, flow = rank[2] + rank[3] + rank[4], [0.0] * 5
            for a, b in e:
                if b < 5:
                    flow[b] += rank[a] / (4 if a == 0 else 2)
            rank = [0.5 * f + 100 + 0.1 * lost for f in flow]
        assert {r.id: r.rank for r in linear.pagerank(g, tolerance=0.0, max_rounds=rounds).collect()} == pytest.approx(dict(enumerate(rank)))
    assert {r.id for r in linear.pagerank(g, tolerance=1e-9).collect()} == set(range(5))
    assert joined == [[(0, 1), (1, 0)]] * 5


@pytest.mark.parametrize("many", (0.0, 2.0))
def test_whole_and_partial_states(spark, graph, edges, monkeypatch, many):
    monkeypatch.setattr(fixpoint, "MANY", many)
    written = []
    monkeypatch.setattr(fixpoint, "_marked", lambda *a, f=fixpoint._marked: written.append(1) or f(*a))
    assert {r.id: r.cost for r in traversal.sssp(graph, 0).collect()} == dijkstra(edges, 0)
    assert bool(written) == (many == 0.0)
    path = Graph.from_edges(spark.range(15).selectExpr("id AS src", "id + 1 AS dst")).symmetrize()
    assert {r.id: r.color for r in traversal.coloring(path).collect()} == {k: k + 1 for k in range(16)}


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_pagerank_total_and_fixed_point(graph, edges, strategy):
    rank = {r.id: r.rank for r in linear.pagerank(graph, strategy=strategy, tolerance=1e-10).collect()}
    assert sum(rank.values()) == pytest.approx(1000)
    out = {v: [b for a, b, *_ in edges if a == v] for v in range(17)}
    lost = sum(rank[v] for v in rank if not out[v])
    for v in rank:
        flow = sum(rank[a] / len(out[a]) for a, b, *_ in edges if b == v)
        assert rank[v] == pytest.approx(0.5 * flow + 0.5 * 1000 / 17 + 0.5 * lost / 17)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_coloring(graph, strategy):
    g = graph.symmetrize()
    pairs = [(r.src, r.dst) for r in g.edges.collect()]
    got = {r.id: r.color for r in traversal.coloring(g, strategy).collect()}
    for v in range(17):
        assert got[v] == 1 + max((got[b] for a, b in pairs if a == v and b < v), default=0)
    assert all(got[a] != got[b] for a, b in pairs)


def test_spmv(spark, graph, edges):
    order = sorted(edges, key=lambda e: (e[0], -e[3]))
    want = [0.0] * 17
    for i, (a, b, *_) in enumerate(order):
        want[a] += (i % 13 + 0.5) * (b % 17 + 0.5)
    m, x = linear.synthetic_matrix(Scratch(spark, "t"), graph)
    for s in STRATEGIES:
        assert {r.id: r.y for r in linear.spmv(m, x, graph.vertices, s).collect()} == dict(enumerate(want))


def test_walks(graph, edges):
    want = {}
    for a, b, *_ in edges:
        for c, d, *_ in edges:
            if b == c:
                want[a, d] = want.get((a, d), 0) + 1
    assert {(r.src, r.dst): r.n for r in linear.walks(graph, 2).collect()} == want


def test_dangling_sends_each_source_once(spark):
    e = spark.range(10_000).selectExpr("id % 3 AS src", "id AS dst")
    out = Graph(spark.range(5).select("id"), e).dangling()
    assert sorted(r.id for r in out.collect()) == [3, 4]
    assert "Aggregate [src" in out._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_orders_are_joined_in_bounded_tasks(spark, data, monkeypatch):
    from skewloom import fixtures

    want = sorted(map(tuple, fixtures.g_trade(spark, data).edges.collect()))
    monkeypatch.setattr(fixtures, "TASK_ROWS", 500)
    edges = fixtures.g_trade(spark, data).edges
    parts = re.findall(r"RepartitionByExpression \[l_orderkey#\d+L\], (\d+)", edges._jdf.queryExecution().optimizedPlan().toString())
    assert int(parts[0]) * 500 >= 6000 and sorted(map(tuple, edges.collect())) == want


def test_degree_stats_ties(spark):
    g = Graph(spark.range(4).select("id"), spark.createDataFrame([(1, 0, 1, 0), (1, 2, 1, 1), (2, 0, 1, 2), (2, 1, 1, 3)], "src long, dst long, weight long, pos long"))
    s = metrics.degree_stats(g).first()
    assert (s.n_nodes, s.n_edges, s.min_node, s.max_node, s.min_degree, s.max_degree) == (4, 4, 0, 1, 0, 2)
    low, high = tables.split_by_degree(g, 2)
    assert {r.id for r in low.collect()} == {0, 3} and {r.id for r in high.collect()} == {1, 2}


def test_metrics_of_disconnected_graph(graph):
    assert not metrics.is_connected(graph, 0).first().connected
    assert metrics.characteristic_path_length(graph).first().path_length is None


def test_clustering_of_known_graph(spark):
    pairs = [(0, 1), (0, 2), (1, 2), (2, 3)]
    e = [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]
    g = Graph(spark.range(5).select("id"), spark.createDataFrame(e, "src long, dst long"))
    assert {r.id: r.coefficient for r in metrics.clustering(g).collect()} == pytest.approx({0: 1.0, 1: 1.0, 2: 1 / 3, 3: 0.0, 4: 0.0})


def test_tree(spark):
    parent = {0: None, 1: 0, 2: 0, 3: 1, 4: 3, 5: 3, 6: 5}
    t = spark.createDataFrame(list(parent.items()), "node long, parent long")
    want = dict.fromkeys(parent, 0)
    for v in parent:
        a = v
        while a is not None:
            want[a] += 1
            a = parent[a]
    for how in ("bottom_up", "ancestors"):
        assert {r.node: r.descendants for r in trees.descendants(t, how).collect()} == want
    assert trees.height(t).first().height == 4


def test_nested_work(spark):
    rows = spark.createDataFrame([(0, 3, 1.5), (1, 0, 2.0), (2, 1, 4.0)], "idx long, iter int, data double")
    work = tables.work_arithmetic(rows["data"], 2)

    def by_hand(d, n):
        v1, v2 = d, 1.0
        for _ in range(2):
            v1 += v2
            v2 += v1
        return n * v2

    want = {0: by_hand(1.5, 3), 1: 0.0, 2: by_hand(4.0, 1)}
    for form, salts in (("auto", 1), ("salt", 1), ("salt", 3), ("degree_split", 2)):
        assert {r.idx: r.rst for r in tables.nested_work(rows, work, form, 2, salts).collect()} == want


def test_nested_work_makes_no_row_of_a_turn(spark):
    n = 2_000_000
    rows = spark.createDataFrame([(0, n, 0.5), (1, 7, 2.0), (2, None, 3.0)], "idx long, iter int, data double")
    for form, threshold in (("salt", 1000), ("degree_split", 5)):
        found = tables.nested_work(rows, rows["data"], form, threshold, 4)
        assert {r.idx: r.rst for r in found.collect()} == {0: 0.5 * n, 1: 14.0, 2: 0.0}
    made = tables.nested_work(spark.range(1000).selectExpr("id AS idx", "900 AS iter", "1D AS data"), strategy="salt")
    assert "turn" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_numbering_over_ranges(spark, monkeypatch):
    import skewloom.plans.ordering as o

    monkeypatch.setattr(o, "RANGE_ROWS", 7)
    df = spark.range(50).selectExpr("(id * 37) % 50 AS k", "id % 3 AS v")
    got = sorted((r.k, r.n) for r in numbered(Scratch(spark, "n"), df, [F.col("k")], "n").collect())
    assert got == [(k, k) for k in range(50)]
    rows = sorted(df.collect())
    sums = {r.k: sum(x.v for x in rows if x.k < r.k) for r in rows}
    assert {r.k: r.s for r in numbered(Scratch(spark, "n"), df, [F.col("k")], "s", F.col("v")).collect()} == sums


def test_numbering_needs_no_window(spark, monkeypatch):
    import skewloom.plans.ordering as o

    monkeypatch.setattr(o, "RANGE_ROWS", 7)
    made = numbered(Scratch(spark, "n"), spark.range(60).selectExpr("(id * 37) % 60 AS k"), [F.col("k").desc()], "n")
    assert sorted((r.n, r.k) for r in made.collect()) == [(k, 59 - k) for k in range(60)]
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_empty_graph(spark):
    g = Graph(spark.range(0).select("id"), spark.createDataFrame([], "src long, dst long, weight long, pos long"))
    assert traversal.coloring(g).count() == 0 and linear.pagerank(g).count() == 0 and traversal.betweenness(g).count() == 0
    assert metrics.degree_stats(g).first().n_nodes == 0
