"""Registered queries of the analytics engine and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .operators import linear, metrics, tables, traversal, trees
from .operators.graph import Graph
from .plans.skew import STRATEGIES
from .session import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Tables of the fixtures in SQL.
VERTICES = "v AS (SELECT c_custkey AS id FROM customer)"
ORDERS = """g AS (SELECT a.o_custkey AS src, b.o_custkey AS dst, CAST(1 + (a.o_orderkey * 7919) % 1000 AS BIGINT) AS weight, a.o_orderkey AS pos
  FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1)"""
TRADE = f"""{VERTICES}, {ORDERS}, nc AS (SELECT count(*) AS n FROM customer), vd AS (SELECT id FROM v UNION ALL SELECT s_suppkey + n FROM supplier, nc),
d AS (SELECT src, dst FROM g UNION ALL SELECT o_custkey, l_suppkey + n FROM orders JOIN lineitem ON o_orderkey = l_orderkey, nc)"""
SUPPLY = """sv AS (SELECT s_suppkey AS id FROM supplier), ns AS (SELECT count(*) AS n FROM supplier),
s AS (SELECT s_suppkey AS src, unnest([(s_suppkey + 1) % n, (7 * s_suppkey + 3) % n, (s_suppkey + s_nationkey + 2) % n]) AS dst FROM supplier, ns)"""
SYM = f"""{VERTICES}, {ORDERS}, y AS (SELECT src, dst FROM g WHERE src <> dst UNION SELECT dst, src FROM g WHERE src <> dst)"""
TREE = "t AS (SELECT c_custkey AS node, CASE WHEN c_custkey > 0 THEN (c_custkey - 1) // 4 END AS parent FROM customer)"
WORK = """w AS (SELECT l_orderkey AS idx, CAST(sum(CAST(trunc(l_quantity) AS INTEGER)) AS INTEGER) AS iter, any_value(o_totalprice) AS data
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)"""


def query(oracle: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


DEGREE = f"""{VERTICES}, {ORDERS}, d AS (SELECT id, count(src) AS degree FROM v LEFT JOIN g ON src = id GROUP BY id)"""


@query(f"""WITH {DEGREE} SELECT count(*) AS n_nodes, CAST(sum(degree) AS BIGINT) AS n_edges, avg(degree) AS avg_degree, min(degree) AS min_degree, max(degree) AS max_degree,
  (SELECT id FROM d ORDER BY degree, id LIMIT 1) AS min_node, (SELECT id FROM d ORDER BY degree DESC, id LIMIT 1) AS max_node FROM d""")
def degree_stats(spark, sf_dir):
    return metrics.degree_stats(fx.g_orders(spark, sf_dir))


@query(f"WITH {DEGREE} SELECT degree, count(*) AS count FROM d GROUP BY degree")
def degree_histogram(spark, sf_dir):
    return metrics.degree_histogram(fx.g_orders(spark, sf_dir))


@query(f"WITH {TRADE} SELECT id FROM vd WHERE id NOT IN (SELECT src FROM d)")
def dangling_vertices(spark, sf_dir):
    return fx.g_trade(spark, sf_dir).dangling()


@query(f"WITH {VERTICES}, {ORDERS} SELECT id, count(dst) AS degree FROM v LEFT JOIN g ON dst = id GROUP BY id")
def invert_degree(spark, sf_dir):
    return fx.g_orders(spark, sf_dir).invert().out_degree()


@query(f"""WITH {ORDERS}, u AS (SELECT src * 10 + 7 AS old FROM g UNION SELECT dst * 10 + 7 FROM g)
SELECT old, row_number() OVER (ORDER BY old) - 1 AS id FROM u""")
def compact_ids(spark, sf_dir):
    e = fx.g_orders(spark, sf_dir).edges
    return Graph(None, e.select((F.col("src") * 10 + 7).alias("src"), (F.col("dst") * 10 + 7).alias("dst"))).compact_ids(Scratch(spark, "compact"))[1]


@query(f"WITH {ORDERS} SELECT src, dst, pos, row_number() OVER (ORDER BY src, pos DESC) - 1 AS i FROM g")
def csr_positions(spark, sf_dir):
    return fx.g_orders(spark, sf_dir).csr_positions(Scratch(spark, "csr")).select("src", "dst", "pos", "i")


@query(f"WITH {DEGREE} SELECT id, degree, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM d")
def csr_row_offsets(spark, sf_dir):
    return fx.g_orders(spark, sf_dir).row_offsets(Scratch(spark, "csr"))


@query(f"WITH {ORDERS} SELECT min(weight) AS least FROM g WHERE src % 2 = 1 AND weight >= 100")
def masked_min(spark, sf_dir):
    return tables.masked_min(fx.g_orders(spark, sf_dir).edges.withColumn("committed", F.col("src") % 2 == 0), "weight", "committed", 100)


@query(f"WITH {ORDERS} SELECT src, dst, weight, pos FROM g ORDER BY weight, pos LIMIT 100")
def edge_sort_topk(spark, sf_dir):
    return tables.edges_by_weight(fx.g_orders(spark, sf_dir), 100)


@query(f"WITH {DEGREE} SELECT id, degree, CASE WHEN degree >= 12 THEN 'high' ELSE 'low' END AS queue FROM d")
def degree_split_frontier(spark, sf_dir):
    low, high = tables.split_by_degree(fx.g_orders(spark, sf_dir), 12)
    return low.withColumn("queue", F.lit("low")).unionByName(high.withColumn("queue", F.lit("high")))


BFS = f"r(id, level) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, level + 1 FROM r JOIN g ON src = id WHERE level < 15)"


@query(f"WITH RECURSIVE {ORDERS}, {BFS} SELECT id, min(level) AS level FROM r GROUP BY id")
def bfs_levels(spark, sf_dir):
    return traversal.bfs(fx.g_orders(spark, sf_dir), 0)


@query(f"WITH RECURSIVE {ORDERS}, {BFS}, m AS (SELECT id, min(level) AS level FROM r GROUP BY id) SELECT level, count(*) AS n FROM m GROUP BY level")
def bfs_level_sizes(spark, sf_dir):
    return traversal.bfs(fx.g_orders(spark, sf_dir), 0).groupBy("level").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {ORDERS}, {BFS} SELECT max(level) + 1 AS n_levels FROM (SELECT id, min(level) AS level FROM r GROUP BY id)")
def bfs_level_count(spark, sf_dir):
    return traversal.bfs(fx.g_orders(spark, sf_dir), 0).agg((F.max("level") + 1).alias("n_levels"))


SSSP = f"""g0 AS (SELECT src, dst, min(weight) AS weight FROM g GROUP BY src, dst UNION ALL SELECT id, id, 0 FROM v),
r(k, id, cost) AS (SELECT 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT k + 1, dst, CAST(min(cost + weight) AS BIGINT) FROM r JOIN g0 ON src = id WHERE k < 30 GROUP BY k, dst)"""


@query(f"WITH RECURSIVE {VERTICES}, {ORDERS}, {SSSP} SELECT id, min(cost) AS cost FROM r GROUP BY id")
def sssp_costs(spark, sf_dir):
    return traversal.sssp(fx.g_orders(spark, sf_dir), 0)


@query(f"""WITH RECURSIVE {VERTICES}, {ORDERS}, {SSSP}, c AS (SELECT id, min(cost) AS cost FROM r GROUP BY id),
b AS (SELECT dst, min(src) AS prev FROM g JOIN c x ON x.id = src JOIN c z ON z.id = dst WHERE x.cost + weight = z.cost GROUP BY dst),
p(path, node) AS (SELECT [CAST(77 AS BIGINT)], CAST(77 AS BIGINT) UNION ALL SELECT list_prepend(prev, path), prev FROM p JOIN b ON dst = node WHERE node <> 0)
SELECT path, (SELECT cost FROM c WHERE id = 77) AS cost FROM p WHERE node = 0""")
def shortest_path(spark, sf_dir):
    return traversal.shortest_path(fx.g_orders(spark, sf_dir), 0, 77)


@query(f"""WITH RECURSIVE {TRADE}, n AS (SELECT count(*) AS n FROM vd),
o AS (SELECT src, count(*) AS c FROM d GROUP BY src),
e AS (SELECT d.src, d.dst, count(*) / any_value(c)::DOUBLE AS p FROM d JOIN o USING (src) GROUP BY d.src, d.dst UNION ALL SELECT id, id, 0::DOUBLE FROM vd),
h AS (SELECT id, id NOT IN (SELECT src FROM o) AS dangling FROM vd),
r(k, id, rank) AS (SELECT 0, id, 1000::DOUBLE / n FROM vd, n UNION ALL
  SELECT k + 1, dst, 0.5::DOUBLE * sum(rank * p) + 0.5::DOUBLE * 1000 / any_value(n) + 0.5::DOUBLE * max(lost) / any_value(n)
  FROM (SELECT k, r.id, rank, sum(CASE WHEN dangling THEN rank ELSE 0 END) OVER () AS lost FROM r JOIN h ON h.id = r.id WHERE k < 20) q JOIN e ON src = q.id, n GROUP BY k, dst)
SELECT id, round(rank, 6) AS rank FROM r WHERE k = 20""")
def pagerank20(spark, sf_dir):
    return _ranks(spark, sf_dir, "auto")


def _ranks(spark, sf_dir, strategy):
    return linear.pagerank(fx.g_trade(spark, sf_dir), tolerance=0.0, max_rounds=20, strategy=strategy).select("id", F.round("rank", 6).alias("rank"))


ALL_PAIRS = """m AS (SELECT src, dst, count(*) AS n FROM s GROUP BY src, dst),
l0(s, v, level) AS (SELECT id, id, 0 FROM sv UNION SELECT l0.s, dst, level + 1 FROM l0 JOIN m ON src = v WHERE level < 24),
l AS (SELECT s, v, min(level) AS level FROM l0 GROUP BY s, v)"""


@query(f"""WITH RECURSIVE {SUPPLY}, {ALL_PAIRS},
c(s, v, level, sigma) AS (SELECT id, id, 0, 1::DOUBLE FROM sv UNION ALL
  SELECT c.s, m.dst, c.level + 1, sum(sigma * n)::DOUBLE FROM c JOIN m ON m.src = c.v JOIN l ON l.s = c.s AND l.v = m.dst AND l.level = c.level + 1 GROUP BY c.s, m.dst, c.level),
b AS (SELECT a.v AS id, sum(a.sigma * z.sigma / e.sigma) AS bc FROM c a JOIN c z ON z.s = a.v JOIN c e ON e.s = a.s AND e.v = z.v
  WHERE e.level = a.level + z.level AND a.v <> a.s AND a.v <> e.v GROUP BY a.v)
SELECT sv.id, round(coalesce(bc, 0::DOUBLE), 6) AS bc FROM sv LEFT JOIN b USING (id)""")
def betweenness(spark, sf_dir):
    return _between(spark, sf_dir, "auto")


def _between(spark, sf_dir, strategy):
    return traversal.betweenness(fx.g_supply(spark, sf_dir), strategy=strategy).select("id", F.round("bc", 6).alias("bc"))


@query(f"""WITH RECURSIVE {SYM}, r(id, color) AS (SELECT id, 1 FROM v UNION SELECT y.src, color + 1 FROM r JOIN y ON y.dst = r.id WHERE y.dst < y.src)
SELECT id, max(color) AS color FROM r GROUP BY id""")
def coloring(spark, sf_dir):
    return traversal.coloring(fx.g_orders(spark, sf_dir).symmetrize())


@query(f"""WITH {VERTICES}, {ORDERS}, p AS (SELECT src, dst, row_number() OVER (ORDER BY src, pos DESC) - 1 AS i FROM g)
SELECT id, coalesce(sum((i % 13 + 0.5::DOUBLE) * (dst % 17 + 0.5::DOUBLE)), 0::DOUBLE) AS y FROM v LEFT JOIN p ON src = id GROUP BY id""")
def spmv(spark, sf_dir):
    return _product(spark, sf_dir, "auto")


def _product(spark, sf_dir, strategy):
    g = fx.g_orders(spark, sf_dir)
    matrix, vector = linear.synthetic_matrix(Scratch(spark, "spmv"), g)
    return linear.spmv(matrix, vector, g.vertices, strategy)


JOIN = "SELECT l_orderkey AS key, o_custkey AS value1, l_suppkey AS value2 FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


@query(JOIN)
def inner_join(spark, sf_dir):
    return tables.inner_join(*fx.j_pair(spark, sf_dir))


@query(f"SELECT value1, count(*) AS n, CAST(sum(value2) AS BIGINT) AS total FROM ({JOIN}) GROUP BY value1")
def inner_join_agg(spark, sf_dir):
    return tables.inner_join(*fx.j_pair(spark, sf_dir)).groupBy("value1").agg(F.count("*").alias("n"), F.sum("value2").alias("total"))


@query(f"WITH {VERTICES}, {ORDERS} SELECT id FROM v WHERE id NOT IN (SELECT dst FROM g WHERE src = 0) AND id <> 0")
def anti_join_unvisited(spark, sf_dir):
    g = fx.g_orders(spark, sf_dir)
    seen = g.edges.where("src = 0").select(F.col("dst").alias("id")).unionByName(spark.createDataFrame([(0,)], "id long"))
    return tables.unvisited(g.vertices, seen)


CLOSURE = f"WITH RECURSIVE {TREE}, a(node, anc) AS (SELECT node, node FROM t UNION ALL SELECT a.node, t.parent FROM a JOIN t ON t.node = a.anc WHERE t.parent IS NOT NULL)"


@query(f"{CLOSURE} SELECT anc AS node, count(*) AS descendants FROM a GROUP BY anc")
def tree_descendants(spark, sf_dir):
    return trees.descendants(fx.t_tree(spark, sf_dir))


@query(f"{CLOSURE} SELECT anc AS node, count(*) AS descendants FROM a GROUP BY anc")
def tree_descendants_ancestor_walk(spark, sf_dir):
    return trees.descendants(fx.t_tree(spark, sf_dir), "ancestors")


@query(f"{CLOSURE} SELECT max(n) - 1 AS height FROM (SELECT node, count(*) AS n FROM a GROUP BY node)")
def tree_height(spark, sf_dir):
    return trees.height(fx.t_tree(spark, sf_dir))


@query(f"WITH {WORK} SELECT idx, iter::DOUBLE AS rst FROM w")
def nested_work_unit(spark, sf_dir):
    return tables.nested_work(fx.w_vector(spark, sf_dir), strategy="salt")


@query(f"WITH {WORK} SELECT idx, round(iter * (6765::DOUBLE * data + 10946::DOUBLE), 2) AS rst FROM w")
def nested_work_arith10(spark, sf_dir):
    out = tables.nested_work(fx.w_vector(spark, sf_dir), tables.work_arithmetic(F.col("data"), 10))
    return out.select("idx", F.round("rst", 2).alias("rst"))


#: F(100) and F(101) of the Fibonacci numbers, as doubles.
@query(f"WITH {WORK} SELECT idx, round(iter * (354224848179261915075::DOUBLE * data + 573147844013817084101::DOUBLE) / 1e21, 0) AS rst FROM w")
def nested_work_arith50(spark, sf_dir):
    out = tables.nested_work(fx.w_vector(spark, sf_dir), tables.work_arithmetic(F.col("data"), 50))
    return out.select("idx", F.round(F.col("rst") / 1e21, 0).alias("rst"))


@query(f"""WITH RECURSIVE {WORK}, f(m, a, b) AS (SELECT 0, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT m + 1, a + b, a + 2 * b FROM f WHERE m < 12)
SELECT idx, round(iter * (a * data + b), 2) AS rst FROM w JOIN f ON m = idx % 13""")
def nested_work_mixed(spark, sf_dir):
    out = tables.nested_work(fx.w_vector(spark, sf_dir), tables.work_arithmetic(F.col("data"), (F.col("idx") % 13).cast("int")))
    return out.select("idx", F.round("rst", 2).alias("rst"))


@query(f"WITH {WORK} SELECT idx, round(iter * (3::DOUBLE * data + 5::DOUBLE), 2) AS rst FROM w")
def nested_work_udf2(spark, sf_dir):
    def two_steps(data: float, turn: int) -> float:
        v1, v2 = data, 1.0
        for _ in range(2):
            v1 += v2
            v2 += v1
        return v2

    return tables.nested_work_udf(fx.w_vector(spark, sf_dir), two_steps).select("idx", F.round("rst", 2).alias("rst"))


@query(f"WITH {WORK} SELECT CAST(sum(iter) AS BIGINT) AS total, min(iter) AS least, max(iter) AS greatest, avg(iter) AS mean, count(*) AS n FROM w")
def vector_profile(spark, sf_dir):
    return tables.vector_profile(fx.w_vector(spark, sf_dir))


@query(f"WITH {WORK} SELECT iter, count(*) AS count FROM w GROUP BY iter")
def vector_histogram(spark, sf_dir):
    return tables.vector_histogram(fx.w_vector(spark, sf_dir))


@query(f"""WITH {ORDERS}, m AS (SELECT src, dst, count(*) AS n FROM g GROUP BY src, dst)
SELECT a.src, c.dst, CAST(sum(a.n * b.n * c.n) AS BIGINT) AS n FROM m a JOIN m b ON b.src = a.dst JOIN m c ON c.src = b.dst GROUP BY a.src, c.dst""")
def walks_len3(spark, sf_dir):
    return linear.walks(fx.g_orders(spark, sf_dir), 3)


@query(f"""WITH RECURSIVE {SYM}, r(id, level) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, level + 1 FROM r JOIN y ON src = id WHERE level < 12), u AS (SELECT count(*) AS unreached FROM v WHERE id NOT IN (SELECT id FROM r))
SELECT unreached = 0 AS connected, unreached FROM u""")
def connected_check(spark, sf_dir):
    return metrics.is_connected(fx.g_orders(spark, sf_dir).symmetrize(), 0)


@query(f"""WITH RECURSIVE {SUPPLY}, {ALL_PAIRS},
t AS (SELECT sum(level) AS hops, count(*) AS pairs FROM l WHERE s <> v) SELECT CASE WHEN pairs = n * (n - 1) THEN round(hops / pairs::DOUBLE, 9) END AS path_length FROM t, ns""")
def char_path_length(spark, sf_dir):
    return metrics.characteristic_path_length(fx.g_supply(spark, sf_dir)).select(F.round("path_length", 9).alias("path_length"))


CLUSTER = """k AS (SELECT src AS id, count(*) AS k FROM one GROUP BY src),
a AS (SELECT x.src AS id, sum(e.w) AS n FROM one x JOIN one z ON x.src = z.src AND x.dst < z.dst JOIN one e ON e.src = x.dst AND e.dst = z.dst GROUP BY x.src),
cc AS (SELECT v.id, CASE WHEN k >= 2 THEN coalesce(n, 0) / (k * (k - 1) / 2::DOUBLE) ELSE 0::DOUBLE END AS c FROM v LEFT JOIN k USING (id) LEFT JOIN a USING (id))"""


@query(f"WITH {SYM}, one AS (SELECT src, dst, 1 AS w FROM y), {CLUSTER} SELECT id, round(c, 9) AS coefficient FROM cc")
def clustering(spark, sf_dir):
    return metrics.clustering(fx.g_orders(spark, sf_dir).symmetrize()).select("id", F.round("coefficient", 9).alias("coefficient"))


WEIGHED = f"""{SYM}, one AS (SELECT src, dst, sum(weight) AS w FROM (SELECT src, dst, weight FROM g WHERE src <> dst UNION ALL SELECT dst, src, weight FROM g WHERE src <> dst) GROUP BY src, dst), {CLUSTER}"""


@query(f"WITH {WEIGHED} SELECT id, round(c, 6) AS coefficient FROM cc")
def clustering_weighted(spark, sf_dir):
    return metrics.clustering(fx.both_ways(fx.g_orders(spark, sf_dir))).select("id", F.round("coefficient", 6).alias("coefficient"))


@query(f"WITH {WEIGHED} SELECT round(avg(c), 6) AS coefficient FROM cc")
def clustering_mean(spark, sf_dir):
    return metrics.mean_clustering(fx.both_ways(fx.g_orders(spark, sf_dir))).select(F.round("coefficient", 6).alias("coefficient"))


def _variant(base: str, strategy: str, make: Callable[[SparkSession, str, str], DataFrame]) -> None:
    """The same logical query under another load-balancing strategy; its SQL is the same."""
    name = f"{base}_{strategy}"
    QUERIES[name] = lambda spark, sf_dir: make(spark, sf_dir, strategy)
    ORACLES[name] = ORACLES[base]


def _arith10(spark, sf_dir, strategy):
    out = tables.nested_work(fx.w_vector(spark, sf_dir), tables.work_arithmetic(F.col("data"), 10), strategy, threshold=64)
    return out.select("idx", F.round("rst", 2).alias("rst"))


for _s in ("degree_split", "salt"):
    _variant("nested_work_arith10", _s, _arith10)
for _s in STRATEGIES[1:]:
    _variant("pagerank20", _s, _ranks)
    _variant("spmv", _s, _product)
    _variant("betweenness", _s, _between)
    _variant("coloring", _s, lambda spark, d, s: traversal.coloring(fx.g_orders(spark, d).symmetrize(), s))
    _variant("bfs_levels", _s, lambda spark, d, s: traversal.bfs(fx.g_orders(spark, d), 0, s))
    _variant("sssp_costs", _s, lambda spark, d, s: traversal.sssp(fx.g_orders(spark, d), 0, s))
    _variant("inner_join", _s, lambda spark, d, s: tables.inner_join(*fx.j_pair(spark, d), strategy=s))


from . import catalog_sources  # noqa: E402, F401 - registers readers, reports and generators
