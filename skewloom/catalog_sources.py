"""Registered queries of readers, reports and generators.

A reader's query writes its format from the tables with the report of that format and reads the files back. A generator's query
has parameters that determine the rows, or returns the law that its rows must keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .catalog import ORDERS, SUPPLY, SYM, TREE, VERTICES, WORK, ORACLES, query
from .functions import uniform
from .operators import metrics, traversal, trees
from .session import Scratch, read_table
from .sources import generators as gen
from .sources import readers, reports


def _file(spark: SparkSession, text: DataFrame) -> str:
    """The folder of a written text file."""
    where = Scratch(spark, "text").path("file")
    text.write.text(where)
    return where


def _size(spark: SparkSession, sf_dir: str) -> int:
    return read_table(spark, sf_dir, "customer").count()


# Readers


@query(f"WITH {ORDERS} SELECT src, dst, weight FROM g")
def read_dimacs9(spark, sf_dir):
    g = fx.g_orders(spark, sf_dir)
    x = readers.read_dimacs9(spark, _file(spark, reports.dimacs9_file(g, g.vertices.count(), g.edges.count())))
    return x.graph.edges.select("src", "dst", "weight")


@query(f"WITH {SYM} SELECT src, dst, (SELECT count(*) FROM y) AS m FROM y")
def read_dimacs10(spark, sf_dir):
    g = fx.g_orders(spark, sf_dir).symmetrize()
    x = readers.read_dimacs10(spark, _file(spark, reports.metis_file(g, g.vertices.count(), g.edges.count() // 2)))
    return x.graph.edges.select("src", "dst", F.lit(x.m).cast("long").alias("m"))


@query(f"""WITH {ORDERS}, e AS (SELECT src * 10 + 7 AS src, dst * 10 + 7 AS dst FROM g), u AS (SELECT src AS old FROM e UNION SELECT dst FROM e),
i AS (SELECT old, row_number() OVER (ORDER BY old) - 1 AS id FROM u) SELECT a.id AS src, b.id AS dst FROM e JOIN i a ON a.old = src JOIN i b ON b.old = dst""")
def read_snap(spark, sf_dir):
    e = fx.g_orders(spark, sf_dir).edges.select((F.col("src") * 10 + 7).alias("src"), (F.col("dst") * 10 + 7).alias("dst"))
    return readers.read_snap(spark, _file(spark, reports.snap_dump(e, _size(spark, sf_dir), e.count()))).graph.edges.select("src", "dst")


@query(f"WITH {ORDERS} SELECT src, dst, weight FROM g")
def read_weighted(spark, sf_dir):
    return readers.read_weighted(spark, _file(spark, reports.weighted_file(fx.g_orders(spark, sf_dir).edges))).graph.edges.select("src", "dst", "weight")


@query(f"WITH {ORDERS} SELECT src, dst, weight FROM g")
def read_weighted_bracketed(spark, sf_dir):
    return readers.read_weighted(spark, _file(spark, reports.weighted_file(fx.g_orders(spark, sf_dir).edges, True))).graph.edges.select("src", "dst", "weight")


PAIR = "SELECT 1 AS t, o_orderkey AS key, o_custkey AS value FROM orders UNION ALL SELECT 2, l_orderkey, l_suppkey FROM lineitem"


@query(PAIR)
def read_table_pair(spark, sf_dir):
    a, b = readers.read_table_pair(spark, _file(spark, reports.table_dump(*fx.j_pair(spark, sf_dir))))
    return a.select(F.lit(1).alias("t"), "key", "value").unionByName(b.select(F.lit(2).alias("t"), "key", "value"))


@query(f"WITH {WORK} SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, iter FROM w")
def read_vector(spark, sf_dir):
    return readers.read_vector(spark, _file(spark, reports.vector_file(fx.w_vector(spark, sf_dir))))


# Reports


@query(f"SELECT 'Node ' || (id + 1) || ' is in level ' || level AS value FROM ({ORACLES['bfs_levels']})")
def report_levels(spark, sf_dir):
    g = fx.g_orders(spark, sf_dir)
    return reports.level_report(traversal.bfs(g, 0).select("id"), traversal.bfs(g, 0))


@query(f"SELECT 'From Node 1 -> ' || (id + 1) || ' is ' || cost AS value FROM ({ORACLES['sssp_costs']})")
def report_costs(spark, sf_dir):
    costs = traversal.sssp(fx.g_orders(spark, sf_dir), 0)
    return reports.cost_report(costs.select("id"), costs, 0)


HALF = f"WITH {VERTICES}, {ORDERS} SELECT id, count(src) * 0.5::DOUBLE AS half FROM v LEFT JOIN g ON src = id GROUP BY id"


def _half(spark, sf_dir, name):
    return fx.g_orders(spark, sf_dir).out_degree().select("id", (F.col("degree") * 0.5).alias(name))


@query(f"SELECT format('Node {{}}: {{:.6f}}', id + 1, half) AS value FROM ({HALF})")
def report_betweenness(spark, sf_dir):
    return reports.bc_report(_half(spark, sf_dir, "bc"))


@query(f"SELECT format('Node {{}}: {{:.10f}}', id + 1, half) AS value FROM ({HALF})")
def report_ranks(spark, sf_dir):
    return reports.rank_report(_half(spark, sf_dir, "rank"))


@query(f"SELECT 'Node ' || (id + 1) || ': ' || color AS value FROM ({ORACLES['coloring']})")
def report_colors(spark, sf_dir):
    return reports.color_report(traversal.coloring(fx.g_orders(spark, sf_dir).symmetrize()))


@query(f"SELECT 'x[' || id || '] = ' || half AS value FROM ({HALF})")
def report_vector(spark, sf_dir):
    return reports.vector_dump(_half(spark, sf_dir, "x"), "id", "x", "x")


@query(f"WITH {ORDERS} SELECT '  ' || src || ' -> ' || dst || ';' AS value FROM g UNION ALL SELECT 'digraph G {{' UNION ALL SELECT '}}'")
def report_dot_directed(spark, sf_dir):
    return reports.dot_graph(fx.g_orders(spark, sf_dir).edges)


@query(f"WITH {SYM} SELECT '  ' || src || ' -- ' || dst || ';' AS value FROM y WHERE src < dst UNION ALL SELECT 'graph G {{' UNION ALL SELECT '}}'")
def report_dot_undirected(spark, sf_dir):
    return reports.dot_graph(fx.g_orders(spark, sf_dir).symmetrize().edges, directed=False)


@query(f"WITH {TREE} SELECT '  ' || parent || ' -> ' || node || ';' AS value FROM t WHERE parent IS NOT NULL UNION ALL SELECT 'digraph G {{' UNION ALL SELECT '}}'")
def report_dot_tree(spark, sf_dir):
    return reports.dot_tree(fx.t_tree(spark, sf_dir))


def _saved(title: str, note: str) -> str:
    return f"""WITH {ORDERS} SELECT src || ' ' || dst AS value FROM g UNION ALL SELECT '{title}' UNION ALL SELECT '{note}'
UNION ALL SELECT '# Nodes: ' || (SELECT count(*) FROM customer) || ' Edges: ' || count(*) FROM g UNION ALL SELECT '# FromNodeID  ToNodeID'"""


@query(_saved("# Generic random connected directed multigraph", "#"))
def save_random_graph(spark, sf_dir):
    e = fx.g_orders(spark, sf_dir).edges
    return reports.random_graph_file(e, _size(spark, sf_dir), e.count(), True, False)


@query(_saved("# Small-world connected undirected proper graph", "# probability: 0.250000, number of rewird edges: 0 (0.000000%)"))
def save_small_world(spark, sf_dir):
    e = fx.g_orders(spark, sf_dir).edges
    return reports.small_world_file(e, _size(spark, sf_dir), e.count(), 0.25, 0)


@query(_saved("# Scale-free connected directed proper graph", "# gamma: 2.500000"))
def save_scale_free(spark, sf_dir):
    e = fx.g_orders(spark, sf_dir).edges
    return reports.scale_free_file(e, _size(spark, sf_dir), e.count(), 2.5)


@query(f"SELECT key || ' ' || value AS value FROM ({PAIR}) UNION ALL SELECT '' || count(*) FROM orders UNION ALL SELECT '' || count(*) FROM lineitem")
def dump_table_pair(spark, sf_dir):
    return reports.table_dump(*fx.j_pair(spark, sf_dir))


@query(f"WITH {WORK} SELECT '' || iter AS value FROM w UNION ALL SELECT '' || count(*) FROM w")
def dump_vector(spark, sf_dir):
    return reports.vector_file(fx.w_vector(spark, sf_dir))


@query(f"WITH {TREE} SELECT '1' || chr(9) || '4' || chr(9) || count(*) AS value, 5 AS n_values FROM t")
def report_stats(spark, sf_dir):
    line = reports.tree_stats(spark, 1, 4, lambda how: trees.descendants(fx.t_tree(spark, sf_dir), how)).split("\t")
    return spark.createDataFrame([("\t".join(line[:3]), len(line))], "value string, n_values int")


NATIONS = "e AS (SELECT a.n_regionkey AS src, b.n_regionkey AS dst, count(*) AS n FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 GROUP BY ALL)"


@query(f"""WITH {NATIONS}, i AS (SELECT src AS id FROM e UNION SELECT dst FROM e), c AS (SELECT a.id, b.id AS to_id FROM i a, i b)
SELECT c.id || string_agg(printf('%3d', coalesce(n, 0)), '' ORDER BY to_id) AS value FROM c LEFT JOIN e ON src = c.id AND dst = to_id GROUP BY c.id""")
def report_matrix(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    after = n.select((F.col("n_nationkey") - 1).alias("prev"), F.col("n_regionkey").alias("dst"))
    e = n.join(after, n["n_nationkey"] == after["prev"]).groupBy(F.col("n_regionkey").alias("src"), "dst").agg(F.count("*").alias("n"))
    return reports.matrix_report(e, "n")


@query(f"""WITH l AS ({ORACLES['bfs_levels']}) SELECT CASE WHEN level IS NULL THEN printf('  Vertex %2d is disconnected from the root vertex.', c_custkey)
ELSE printf('  Vertex %2d is of level %d.', c_custkey, level) END AS value FROM customer LEFT JOIN l ON id = c_custkey UNION ALL SELECT 'With vertex 0 as the root:'""")
def report_bfs(spark, sf_dir):
    g = fx.g_orders(spark, sf_dir)
    return reports.bfs_report(g.vertices, traversal.bfs(g, 0), 0)


@query(f"""WITH p AS ({ORACLES['shortest_path']}) SELECT 'Minimum path weight is ' || cost || '.' AS value FROM p UNION ALL SELECT 'Path: ' || array_to_string(path, ' -> ') FROM p
UNION ALL SELECT '(There may be other paths of equal length.)'""")
def report_path(spark, sf_dir):
    return reports.path_report(traversal.shortest_path(fx.g_orders(spark, sf_dir), 0, 77))


# Generators


def _law(graph, n: int) -> DataFrame:
    """One row: vertices, edges, distinct edges, loops, least and greatest out-degree."""
    e = graph.edges.agg(F.count("*").alias("n_edges"), F.count_distinct("src", "dst").alias("n_distinct"), F.coalesce(F.sum((F.col("src") == F.col("dst")).cast("long")), F.lit(0)).alias("n_loops"))
    d = graph.out_degree().agg(F.count("*").alias("n"), F.min("degree").alias("least"), F.max("degree").alias("greatest"))
    both = {**e.first().asDict(), **d.first().asDict()}
    return graph.edges.sparkSession.createDataFrame([tuple(both[c] for c in ("n", "n_edges", "n_distinct", "n_loops", "least", "greatest"))], "n long, n_edges long, n_distinct long, n_loops long, least long, greatest long")


def _law_sql(d: int, edges: str) -> str:
    return f"SELECT n, {edges} AS n_edges, {edges} AS n_distinct, CAST(0 AS BIGINT) AS n_loops, CAST({d} AS BIGINT) AS least, CAST({d} AS BIGINT) AS greatest FROM (SELECT count(*) AS n FROM customer)"


@query(_law_sql(5, "5 * n"))
def generate_degree_graph(spark, sf_dir):
    n = _size(spark, sf_dir)
    return _law(gen.degree_graph(spark, n, 5, 5), n)


@query(_law_sql(4, "4 * n"))
def generate_random_directed(spark, sf_dir):
    n = _size(spark, sf_dir)
    return _law(gen.random_directed(spark, n, 4, 4), n)


@query("SELECT count(*) AS n, true AS connected, true AS within, true AS symmetric, true AS nearly_full FROM customer")
def generate_random_undirected(spark, sf_dir):
    n = _size(spark, sf_dir)
    scratch = Scratch(spark, "law")
    made = gen.random_undirected(spark, n, 4, 6)
    made.edges = scratch.table(made.edges, "edges")
    d = made.out_degree().agg(F.count("*").alias("n"), (F.max("degree") <= 6).alias("within"), F.sum((F.col("degree") < 4).cast("int")).alias("short")).first()
    turned = made.edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    alone = made.edges.join(turned, (made.edges["src"] == turned["a"]) & (made.edges["dst"] == turned["b"]), "left_anti").count()
    linked = metrics.is_connected(made, 0).first()["connected"]
    return spark.createDataFrame([(d["n"], linked, d["within"], alone == 0, d["short"] <= 2)], "n long, connected boolean, within boolean, symmetric boolean, nearly_full boolean")


RING = f"SELECT c_custkey AS src, (c_custkey + j) % n AS dst FROM customer, (SELECT count(*) AS n FROM customer), (SELECT unnest([1, 2, 3]) AS j)"


@query(RING)
def generate_ring_lattice(spark, sf_dir):
    return gen.ring_lattice(spark, _size(spark, sf_dir), 6).edges.select("src", "dst")


@query(RING)
def generate_small_world_unmoved(spark, sf_dir):
    return gen.small_world(spark, _size(spark, sf_dir), 6, 0.0).edges.select("src", "dst")


@query(_law_sql(3, "3 * n"))
def generate_small_world(spark, sf_dir):
    n = _size(spark, sf_dir)
    return _law(gen.small_world(spark, n, 6, 0.5), n)


@query("""WITH c AS (SELECT count(*) AS n FROM customer), w AS (SELECT d AS degree, CAST(floor(n / d ** 2.5::DOUBLE + 0.5) AS BIGINT) AS k FROM c, (SELECT unnest(range(2, (SELECT n FROM c))) AS d)),
a AS (SELECT degree, k FROM w WHERE k > 0 UNION ALL SELECT 1, n - (SELECT sum(k) FROM w WHERE k > 0) FROM c)
SELECT CAST(degree AS BIGINT) AS degree, CAST(k AS BIGINT) AS expected, CAST(k AS BIGINT) AS actual FROM a""")
def generate_scale_free(spark, sf_dir):
    return gen.scale_free(spark, _size(spark, sf_dir), 2.5)[1]


@query("SELECT count(*) AS n1, CAST(1 AS BIGINT) AS first, true AS steps, true AS inside, (SELECT count(*) FROM orders) AS n2 FROM customer")
def generate_table_pair(spark, sf_dir):
    n2 = read_table(spark, sf_dir, "orders").count()
    a, b = gen.table_pair(spark, _size(spark, sf_dir), n2)
    one = a.agg(F.count("*").alias("n1"), F.count_distinct("key").alias("keys"), F.min("key").alias("first"), F.max("key").alias("top"), F.min("value").alias("low"), F.max("value").alias("high")).first()
    two = b.agg(F.count("*").alias("n2"), F.min("key").alias("low"), F.max("key").alias("top")).first()
    steps = one["keys"] == one["n1"] and one["n1"] <= one["top"] <= 3 * one["n1"] and 1 <= one["low"] and one["high"] <= 6666
    return spark.createDataFrame([(one["n1"], one["first"], steps, 1 <= two["low"] and two["top"] <= one["top"], two["n2"])], "n1 long, first long, steps boolean, inside boolean, n2 long")


@query("SELECT count(*) AS n, true AS uniform, true AS power, true AS middle FROM customer")
def generate_trip_counts(spark, sf_dir):
    n = _size(spark, sf_dir)
    u, p = gen.trip_counts(spark, n, 1, 51), gen.trip_counts(spark, n, 1, 2000, 1.4)
    a = u.agg(F.min("iter"), F.max("iter"), F.avg("iter"), F.count("*")).first()
    b = p.agg(F.min("iter"), F.max("iter"), F.avg("iter")).first()
    # The mean of a density x^k up to h is near h (k + 1) / (k + 2).
    return spark.createDataFrame([(a[3], 1 <= a[0] and a[1] <= 50, 1 <= b[0] and b[1] <= 2000, 20 < a[2] < 31 and 1250 < b[2] < 1560)], "n long, uniform boolean, power boolean, middle boolean")


@query("""WITH n AS (SELECT range AS node FROM range(1 + 4 + 16 + 64 + 256)) SELECT node, CASE WHEN node > 0 THEN (node - 1) // 4 END AS parent,
CASE WHEN node >= 85 THEN 4 WHEN node >= 21 THEN 3 WHEN node >= 5 THEN 2 WHEN node >= 1 THEN 1 ELSE 0 END AS level FROM n""")
def generate_regular_tree(spark, sf_dir):
    return gen.regular_tree(spark, 5, 4)


@query("SELECT level, CAST(3 ** level AS BIGINT) AS n, CAST(3 ** (level - 1) AS BIGINT) AS parents FROM (SELECT unnest([1, 2, 3, 4, 5]) AS level)")
def generate_random_tree(spark, sf_dir):
    return gen.random_tree(spark, 5, 5, 3, 3, 0).where("level > 0").groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("parent").alias("parents"))


@query("""SELECT count(*) AS n, true AS unit, CAST(7 AS BIGINT) AS equal, CAST(-1 AS BIGINT) AS turned, true AS inside, true AS power, CAST(1 AS BIGINT) AS sure, true AS means FROM customer""")
def generate_columns(spark, sf_dir):
    v = spark.range(_size(spark, sf_dir))
    u = v.select(
        uniform.uniform(1, "id").alias("u"), uniform.integer(1, 7, 7, "id").alias("e"), uniform.integer(1, 9, 3, "id").alias("t"), uniform.integer(1, 3, 9, "id").alias("i"),
        uniform.power_law(1, 1, 50, -2.0, "id").alias("p"), uniform.geometric(1, 1.0, "id").alias("s"), uniform.exponential(1, 4.0, "id").alias("x"),
        uniform.geometric(2, 0.25, "id").alias("g"), uniform.pareto(3, 4.0, 3.0, "id").alias("o"),
    )
    near = lambda c: (F.avg(c) > 2.5) & (F.avg(c) < 6)
    return u.agg(
        F.count("*").alias("n"), ((F.min("u") >= 0) & (F.max("u") < 1)).alias("unit"), F.max("e").alias("equal"), F.max("t").alias("turned"),
        ((F.min("i") == 3) & (F.max("i") == 8)).alias("inside"), ((F.min("p") >= 1) & (F.max("p") <= 50)).alias("power"), F.max("s").alias("sure"),
        (near("x") & near("g") & near("o")).alias("means"),
    )


@query("SELECT unnest([1, 2]) AS trial, 0 AS rewired, 1::DOUBLE AS path_ratio, 1::DOUBLE AS cluster_ratio")
def small_world_trials_unmoved(spark, sf_dir):
    out = metrics.small_world_trials(spark, 30, 4, 0.0, trials=2)
    return out.select(F.col("trial").cast("int").alias("trial"), F.col("rewired").cast("int").alias("rewired"), "path_ratio", "cluster_ratio")
