"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import ROUGHLY, Query, statistics
from .functions import stats
from .operators import relation as rel
from .operators.yannakakis import Yannakakis, tree
from .plans.cost import Evaluator
from .plans.decompose import decompositions
from .plans.export import plan_table
from .plans.hypergraph import Hypergraph
from .sources.csv_files import load_database, load_statistics, parse_database
from .sources.tables import bind, shared_folder, table

CHAIN = {
    "region": ("region", {"r_regionkey": "rk"}),
    "nation": ("nation", {"n_nationkey": "nk", "n_regionkey": "rk"}),
    "customer": ("customer", {"c_custkey": "ck", "c_nationkey": "nk"}),
    "orders": ("orders", {"o_orderkey": "ok", "o_custkey": "ck"}),
}
CYCLE = CHAIN | {
    "lineitem": ("lineitem", {"l_orderkey": "ok", "l_suppkey": "sk"}),
    "supplier": ("supplier", {"s_suppkey": "sk", "s_nationkey": "nk"}),
}
CYCLE_GRAPH = "region(rk), nation(nk,rk), customer(ck,nk), orders(ok,ck), lineitem(ok,sk), supplier(sk,nk)."
TRIANGLE = {
    "a": ("lineitem", {"l_orderkey": "ok", "l_suppkey": "sk"}),
    "b": ("lineitem", {"l_suppkey": "sk", "l_partkey": "pk"}),
    "c": ("lineitem", {"l_orderkey": "ok", "l_partkey": "pk"}),
}

#: A cycle whose atoms, joined as written, make every customer's pairs with the suppliers of a nation first.
LOCAL = {n: CYCLE[n] for n in ("customer", "supplier", "lineitem", "orders")}

# The rows of the three test cases of the evaluator, whose answers are known.
CASE1 = """\
r,d,Y,P
t,3,8
t,3,7
t,5,7
t,6,7
r,r,Y,Z,U
t,3,8,9
t,9,3,8
t,8,3,8
t,3,8,4
t,3,8,3
t,8,9,4
t,9,4,7
r,s,Z,U,W
t,3,8,9
t,9,3,8
t,8,3,8
t,3,8,4
t,3,8,3
t,8,9,4
t,9,4,7
r,t,V,Z
t,9,8
t,9,3
t,9,5
"""
CASE2 = CASE1 + """\
r,a,P,C
t,8,4
t,8,7
t,4,9
t,3,5
r,b,C,A
t,4,1
t,3,2
t,5,4
"""
CASE3 = CASE1[: CASE1.index("r,t,")] + "r,t,V,Z\nt,9,7\nt,9,6\nt,9,5\n"


def fixture(spark: SparkSession, text: str, reduce: str = "full") -> Yannakakis:
    t = {name: rel.relation(spark, *parts) for name, parts in parse_database(text).items()}
    below = [tree("r", t["r"], tree("s", t["s"]), tree("t", t["t"]))]
    if "a" in t:
        below.append(tree("a", t["a"], tree("b", t["b"])))
    return Yannakakis(tree("d", t["d"], *below), reduce)


def atoms(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    bound = bind(spark, d, {n: CYCLE[n] for n in names})
    return [bound[n] for n in names]


def chain(spark: SparkSession, d: str, condition: str = "o_totalprice > 200000", reduce: str = "full") -> Yannakakis:
    """region - nation - customer - orders, with a filter that reaches the scan of orders."""
    region, nation, customer = atoms(spark, d, "region", "nation", "customer")
    orders = rel.rename(rel.select(table(spark, d, "orders"), condition), {"o_orderkey": "ok", "o_custkey": "ck"})
    return Yannakakis(tree("region", region, tree("nation", nation, tree("customer", customer, tree("orders", orders)))), reduce)


def cycle(spark: SparkSession, d: str, **options) -> Query:
    tables = bind(spark, d, CYCLE)
    return Query(Hypergraph.parse(CYCLE_GRAPH), tables, evaluator=Evaluator(statistics(tables, ROUGHLY)), **options)


def natural_join_orders_customer(spark, d):
    return rel.natural_join(*atoms(spark, d, "orders", "customer"))


def cross_region_nation(spark, d):
    return rel.natural_join(rel.rename(table(spark, d, "region"), {"r_name": "region"}), rel.rename(table(spark, d, "nation"), {"n_name": "nation"}))


def self_intersection_bag(spark, d):
    lineitem = atoms(spark, d, "lineitem")[0]
    return rel.natural_join(lineitem, lineitem)


def semijoin_customer_orders(spark, d):
    orders = rel.rename(rel.select(table(spark, d, "orders"), "o_totalprice > 400000"), {"o_orderkey": "ok", "o_custkey": "ck"})
    return rel.semijoin(atoms(spark, d, "customer")[0], orders)


def semijoin_no_common(spark, d):
    region, orders = atoms(spark, d, "region", "orders")
    return rel.semijoin(region, orders)


def select_orders_filter(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rel.select(orders, (F.col("o_totalprice") > 100000) & (F.col("o_custkey") % 2 == 0))


def project_bag_distinct(spark, d):
    return rel.project(atoms(spark, d, "lineitem")[0], ["ok", "sk"])


def node_join_three_tables(spark, d):
    return rel.join_all(atoms(spark, d, "customer", "orders", "lineitem"))


def stats_size_ndv_lineitem(spark, d):
    columns = {"l_orderkey": "ok", "l_partkey": "pk", "l_suppkey": "sk"}
    return stats.size_and_ndv(rel.rename(table(spark, d, "lineitem"), columns))


def histogram_orders_custkey(spark, d):
    return stats.histogram(table(spark, d, "orders"), "o_custkey")


def hist_join_matching(spark, d):
    return stats.selectivity(atoms(spark, d, "customer", "supplier", "nation"), "nk")


def hist_semijoin_selectivity(spark, d):
    orders = rel.rename(rel.select(table(spark, d, "orders"), "o_totalprice > 400000"), {"o_custkey": "ck"})
    return stats.semijoin_selectivity(atoms(spark, d, "customer")[0], orders, "ck")


def estimate_join_size_ndv(spark, d):
    parts = [stats.collect(x) for x in atoms(spark, d, "customer", "orders", "supplier", "nation")]
    made = stats.estimate_join(parts)
    return spark.createDataFrame([(made.size, made.ndv["ck"], made.ndv["nk"])], "est_size long, ndv_ck long, ndv_nk long")


def estimate_semijoin_size_ndv(spark, d):
    supplier, nation = (stats.collect(x) for x in atoms(spark, d, "supplier", "nation"))
    made = [stats.estimate_semijoin(supplier, nation).size, stats.estimate_semijoin(nation, supplier).size]
    return spark.createDataFrame([tuple(made)], "est_supplier long, est_nation long")


def _histograms(spark, d) -> list[stats.Statistics]:
    return [stats.collect(x.select("nk"), histograms=True) for x in atoms(spark, d, "customer", "supplier", "nation")]


def estimate_join_size_hist(spark, d):
    made = stats.estimate_join(_histograms(spark, d))
    return spark.createDataFrame([(made.size, made.ndv["nk"])], "est_size long, ndv_nk long")


def estimate_semijoin_size_hist(spark, d):
    customer, supplier, nation = _histograms(spark, d)
    few = stats.collect(rel.rename(rel.select(table(spark, d, "supplier"), "s_nationkey % 3 = 0"), {"s_nationkey": "nk"}), histograms=True)
    made = [stats.estimate_semijoin(customer, few).size, stats.estimate_semijoin(nation, supplier).size]
    return spark.createDataFrame([tuple(made)], "est_customer long, est_nation long")


def yannakakis_chain_all(spark, d):
    return chain(spark, d).all_answers()


def yannakakis_chain_reduced_root(spark, d):
    return chain(spark, d, "o_totalprice > 480000").reduced().joined


def yannakakis_chain_fully_reduced_leaf(spark, d):
    y = chain(spark, d)
    root = y.root
    europe = tree("region", rel.rename(rel.select(table(spark, d, "region"), "r_name = 'EUROPE'"), {"r_regionkey": "rk"}), *root.children)
    return Yannakakis(europe).fully_reduced().named()["orders"]


def yannakakis_bool_sat(spark, d):
    return chain(spark, d).satisfiable()


def yannakakis_bool_unsat(spark, d):
    return chain(spark, d, "o_totalprice < 0").satisfiable()


def cq_cycle_best(spark, d):
    return cycle(spark, d).answers()


def cq_cycle_bnb(spark, d):
    return cycle(spark, d, mode="bnb").answers()


def cq_cycle_set(spark, d):
    return cycle(spark, d).answers("set")


def cq_cycle_full_reduction(spark, d):
    return cycle(spark, d).answers(reduce="full", store=True)


def cq_local_suppliers(spark, d):
    tables = bind(spark, d, LOCAL)
    return Query(Hypergraph.parse("customer(ck,nk), supplier(sk,nk), lineitem(ok,sk), orders(ok,ck)."), tables).answers()


def node_join_repeated_relation(spark, d):
    customer, orders = atoms(spark, d, "customer", "orders")
    return rel.join_all([customer, orders, orders])


def cq_triangle_complete(spark, d):
    tables = bind(spark, d, TRIANGLE)
    return Query(Hypergraph.parse("a(ok,sk), b(sk,pk), c(ok,pk)."), tables, evaluator=Evaluator(statistics(tables, ROUGHLY))).answers()


def shrink_soft_answers(spark, d):
    return cycle(spark, d, shrink="soft", complete=True).answers()


def shrink_hard_answers(spark, d):
    return cycle(spark, d, shrink="hard", complete=True).answers()


def decompositions_enum(spark, d):
    return plan_table(spark, decompositions(Hypergraph.parse("R(a,b), S(b,c), T(c,d)."), 1))


def decompositions_cycle_width2(spark, d):
    return plan_table(spark, decompositions(Hypergraph.parse("R(a,b), S(b,c), T(a,c)."), 2))


def cost_ranking(spark, d):
    """All trees of a path of three atoms, by exact statistics."""
    names = ("customer", "nation")
    tables = bind(spark, d, {n: CYCLE[n] for n in names} | {"region": ("region", {"r_regionkey": "rk", "r_name": "rn"})})
    graph = Hypergraph.parse("customer(ck,nk), nation(nk,rk), region(rk,rn).")
    costs = Evaluator(statistics(tables))
    found = sorted((costs.cost(t), i, t) for i, t in enumerate(decompositions(graph, 1)))
    return spark.createDataFrame([(i + 1, float(c), ",".join(t.root.cover)) for i, (c, _, t) in enumerate(found)], "rank int, cost double, root string")


def cost_ranking_cycle(spark, d):
    """All trees of the six-way cycle, by approximate distinct counts."""
    q = cycle(spark, d)
    costs = sorted((q.costs().cost(t), i, t) for i, t in enumerate(decompositions(q.graph, 2)))
    rows = [(i + 1, float(c), t.width(), str(t)) for i, (c, _, t) in enumerate(costs)]
    return spark.createDataFrame(rows, "rank int, cost double, width int, tree string")


def fixture_case1(spark, d):
    return fixture(spark, CASE1).all_answers()


def fixture_case2(spark, d):
    return fixture(spark, CASE2).all_answers()


def fixture_case3(spark, d):
    return fixture(spark, CASE3).satisfiable()


def load_csv_database(spark, d):
    loaded = {name: rel.relation(spark, *parts) for name, parts in parse_database("r,R,a,b\nt,1,2\nt,1,3\nt,,01\nr,S,b,c\nt,2,9\nt,01,\n").items()}
    return rel.natural_join(loaded["R"], loaded["S"])


def _written(spark, lines: DataFrame) -> str:
    """A file with these lines, in their order."""
    folder = shared_folder(spark)
    lines.coalesce(1).write.text(folder)
    return folder


def load_csv_file(spark, d):
    """Nations and regions written as a database file, one field with a line break, a quote and a comma, and loaded again."""
    quoted = F.concat(F.lit('"'), F.replace(F.col("name"), F.lit('"'), F.lit('""')), F.lit('"'))
    head = lambda text: spark.createDataFrame([(text,)], "value string")
    region = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("k"), F.concat("r_name", F.lit(', "r"\nof ')).alias("name"))
    nation = table(spark, d, "nation").selectExpr("concat('t,', n_nationkey, ',', n_regionkey) AS value")
    lines = head("r,nation,nk,rk").union(nation).union(head("r,region,rk,rn")).union(region.select(F.concat(F.lit("t,"), "k", F.lit(","), quoted)))
    loaded = load_database(spark, _written(spark, lines))
    return rel.natural_join(loaded["nation"], loaded["region"])


def load_statistics_file(spark, d):
    text = ["size,R,100", "ndv,R,a,10", "ndv,R,b,20", "size,S,50", "ndv,S,b,5", "size,T,7", "size,R,S,200", "note,3"]
    path = _written(spark, spark.createDataFrame([(x,) for x in text], "value string").coalesce(1))
    graph = Hypergraph.parse("R(a,b), S(b,c), T(c,d).")
    single, joins = load_statistics(spark, path, graph)
    rows = [(e, s.size, ",".join(f"{v}={s.ndv[v]}" for v in sorted(s.ndv))) for e, s in single.items()]
    rows += [(",".join(sorted(k)), n, "") for k, n in joins.items()]
    return spark.createDataFrame(rows, "edges string, size long, ndv string")


def _random(spark, n: int, shift: int) -> DataFrame:
    """Three columns of 500, 200 and 100 values that look random."""
    value = lambda by, m: f"cast((id + {shift}) * {by} % 2147483647 % {m} as string)"
    return spark.range(1, n + 1).selectExpr(f"{value(48271, 500)} AS a", f"{value(69621, 200)} AS b", f"{value(16807, 100)} AS c")


SMALL, BIG = (1000, 0), (100_000, 5_000_000)


def join_small_big(spark, d):
    return rel.natural_join(_random(spark, *SMALL), _random(spark, *BIG))


def join_big_small(spark, d):
    return rel.natural_join(_random(spark, *BIG), _random(spark, *SMALL))


def semijoin_small_big(spark, d):
    return rel.semijoin(_random(spark, *SMALL), _random(spark, *BIG))


def semijoin_big_small(spark, d):
    return rel.semijoin(_random(spark, *BIG), _random(spark, *SMALL))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        natural_join_orders_customer, cross_region_nation, self_intersection_bag, semijoin_customer_orders, semijoin_no_common, select_orders_filter,
        project_bag_distinct, node_join_three_tables, stats_size_ndv_lineitem, histogram_orders_custkey, hist_join_matching, hist_semijoin_selectivity,
        estimate_join_size_ndv, estimate_semijoin_size_ndv, yannakakis_chain_all, yannakakis_chain_reduced_root, yannakakis_chain_fully_reduced_leaf,
        yannakakis_bool_sat, yannakakis_bool_unsat, cq_cycle_best, cq_cycle_bnb, cq_cycle_set, cq_cycle_full_reduction, cq_triangle_complete,
        shrink_soft_answers, shrink_hard_answers, decompositions_enum, decompositions_cycle_width2, cost_ranking, cost_ranking_cycle, fixture_case1, fixture_case2, fixture_case3,
        load_csv_database, load_csv_file, load_statistics_file, node_join_repeated_relation, cq_local_suppliers, estimate_join_size_hist, estimate_semijoin_size_hist,
        join_small_big, join_big_small, semijoin_small_big, semijoin_big_small,
    )
}

_CYCLE_SQL = """
SELECT {d} c_custkey AS ck, c_nationkey AS nk, o_orderkey AS ok, r_regionkey AS rk, s_suppkey AS sk
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey"""
_CYCLE_BAG = _CYCLE_SQL.format(d="")
_CHAIN_SQL = "FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey"



def _random_sql(n: int, shift: int) -> str:
    value = lambda by, m: f"CAST((i + {shift}) * {by} % 2147483647 % {m} AS VARCHAR)"
    return f"(SELECT {value(48271, 500)} AS a, {value(69621, 200)} AS b, {value(16807, 100)} AS c FROM range(1, {n + 1}) t(i))"


_JOIN_SQL = f"SELECT s.a, s.b, s.c FROM {_random_sql(*SMALL)} s JOIN {_random_sql(*BIG)} b ON s.a = b.a AND s.b = b.b AND s.c = b.c"
_SEMIJOIN_SQL = "SELECT a, b, c FROM {0} x WHERE EXISTS (SELECT 1 FROM {1} y WHERE x.a = y.a AND x.b = y.b AND x.c = y.c)"


ORACLES: dict[str, str] = {
    "join_small_big": _JOIN_SQL,
    "join_big_small": _JOIN_SQL,
    "semijoin_small_big": _SEMIJOIN_SQL.format(_random_sql(*SMALL), _random_sql(*BIG)),
    "semijoin_big_small": _SEMIJOIN_SQL.format(_random_sql(*BIG), _random_sql(*SMALL)),
    "node_join_repeated_relation": "SELECT c_custkey AS ck, c_nationkey AS nk, a.o_orderkey AS ok FROM customer JOIN orders a ON a.o_custkey = c_custkey JOIN orders b ON b.o_orderkey = a.o_orderkey AND b.o_custkey = a.o_custkey",
    "load_csv_file": """
SELECT CAST(n_nationkey AS VARCHAR) AS nk, CAST(n_regionkey AS VARCHAR) AS rk, r_name || ', "r"' || chr(10) || 'of ' AS rn
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "load_statistics_file": """
SELECT edges, CAST(size AS BIGINT) AS size, ndv FROM (VALUES
('R', 100, 'a=10,b=20'), ('S', 50, 'b=5,c=50'), ('T', 7, 'c=7,d=7'), ('R,S', 200, '')) t(edges, size, ndv)""",
    "cq_local_suppliers": """
SELECT c_custkey AS ck, c_nationkey AS nk, o_orderkey AS ok, s_suppkey AS sk
FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey""",
    "estimate_join_size_hist": """
WITH a AS (SELECT c_nationkey AS v, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS v, count(*) AS n FROM supplier GROUP BY 1),
c AS (SELECT n_nationkey AS v, count(*) AS n FROM nation GROUP BY 1)
SELECT CAST(sum(a.n * b.n * c.n) AS BIGINT) AS est_size, count(*) AS ndv_nk FROM a JOIN b USING (v) JOIN c USING (v)""",
    "estimate_semijoin_size_hist": """
SELECT (SELECT count(*) FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_nationkey % 3 = 0)) AS est_customer,
       (SELECT count(*) FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)) AS est_nation""",
    "decompositions_cycle_width2": """
WITH b(cover, bag) AS (VALUES ('R', 'a,b'), ('S', 'b,c'), ('T', 'a,c'), ('R,S', 'a,b,c'), ('R,T', 'a,b,c'), ('S,T', 'a,b,c')),
t(decomp_id, root, child) AS (VALUES (0, 'R', 'R,S'), (1, 'R', 'R,T'), (2, 'R', 'S,T'), (3, 'S', 'R,S'), (4, 'S', 'R,T'), (5, 'S', 'S,T'),
  (6, 'T', 'R,S'), (7, 'T', 'R,T'), (8, 'T', 'S,T'), (9, 'R,S', NULL), (10, 'R,T', NULL), (11, 'S,T', NULL))
SELECT CAST(decomp_id AS INTEGER) AS decomp_id, CAST(0 AS INTEGER) AS node_id, CAST(-1 AS INTEGER) AS parent_id, bag, cover FROM t JOIN b ON cover = root
UNION ALL SELECT CAST(decomp_id AS INTEGER), CAST(1 AS INTEGER), CAST(0 AS INTEGER), bag, cover FROM t JOIN b ON cover = child""",
    "cost_ranking": """
WITH s AS (
  SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(DISTINCT c_custkey) FROM customer) AS c_ck, (SELECT count(DISTINCT c_nationkey) FROM customer) AS c_nk,
         (SELECT count(*) FROM nation) AS n, (SELECT count(DISTINCT n_nationkey) FROM nation) AS n_nk, (SELECT count(DISTINCT n_regionkey) FROM nation) AS n_rk,
         (SELECT count(*) FROM region) AS r, (SELECT count(DISTINCT r_regionkey) FROM region) AS r_rk, (SELECT count(DISTINCT r_name) FROM region) AS r_rn),
m AS (SELECT *, least(n, n_nk * least(n_rk, r_rk)) AS n_by_r, least(n, least(n_nk, c_nk) * n_rk) AS n_by_c FROM s),
k(i, root, cost) AS (
  SELECT 0, 'customer', r + n + n_by_r + c + least(c, c_ck * least(c_nk, n_nk)) FROM m
  UNION ALL SELECT 1, 'nation', n + c + n_by_c + r + least(n_by_c, least(n_nk, c_nk) * least(n_rk, r_rk)) FROM m
  UNION ALL SELECT 2, 'region', r + n + c + n_by_c + least(r, least(r_rk, n_rk) * r_rn) FROM m)
SELECT CAST(row_number() OVER (ORDER BY cost, i) AS INTEGER) AS rank, CAST(cost AS DOUBLE) AS cost, root FROM k""",
    "natural_join_orders_customer": "SELECT o_orderkey AS ok, c_custkey AS ck, c_nationkey AS nk FROM orders JOIN customer ON o_custkey = c_custkey",
    "cross_region_nation": "SELECT r_name AS region, n_name AS nation FROM region CROSS JOIN nation",
    "self_intersection_bag": "SELECT a.l_orderkey AS ok, a.l_suppkey AS sk FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey",
    "semijoin_customer_orders": "SELECT c_custkey AS ck, c_nationkey AS nk FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "semijoin_no_common": "SELECT r_regionkey AS rk FROM region",
    "select_orders_filter": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_custkey % 2 = 0",
    "project_bag_distinct": "SELECT DISTINCT l_orderkey AS ok, l_suppkey AS sk FROM lineitem",
    "node_join_three_tables": "SELECT c_custkey AS ck, c_nationkey AS nk, o_orderkey AS ok, l_suppkey AS sk FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey",
    "stats_size_ndv_lineitem": "SELECT count(*) AS size, count(DISTINCT l_orderkey) AS ndv_ok, count(DISTINCT l_partkey) AS ndv_pk, count(DISTINCT l_suppkey) AS ndv_sk FROM lineitem",
    "histogram_orders_custkey": "SELECT o_custkey AS value, count(*) AS freq FROM orders GROUP BY o_custkey",
    "hist_join_matching": """
WITH a AS (SELECT c_nationkey AS v, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS v, count(*) AS n FROM supplier GROUP BY 1),
c AS (SELECT n_nationkey AS v, count(*) AS n FROM nation GROUP BY 1),
m AS (SELECT CAST(sum(a.n * b.n * c.n) AS BIGINT) AS matching FROM a JOIN b USING (v) JOIN c USING (v))
SELECT matching, matching / ((SELECT count(*) FROM customer)::DOUBLE * (SELECT count(*) FROM supplier) * (SELECT count(*) FROM nation)) AS selectivity FROM m""",
    "hist_semijoin_selectivity": """
WITH m AS (SELECT count(*) AS matching FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000))
SELECT matching, matching / (SELECT count(*) FROM customer)::DOUBLE AS selectivity FROM m""",
    "estimate_join_size_ndv": """
WITH s AS (
  SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM nation) AS n,
         (SELECT count(DISTINCT c_custkey) FROM customer) AS cck, (SELECT count(DISTINCT o_custkey) FROM orders) AS ock,
         (SELECT count(DISTINCT c_nationkey) FROM customer) AS cnk, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS snk, (SELECT count(DISTINCT n_nationkey) FROM nation) AS nnk),
r AS (SELECT CAST(round(c::DOUBLE * o * s * n / (greatest(cck, ock)::DOUBLE * cnk * snk * nnk / least(cnk, snk, nnk)
             * (SELECT count(DISTINCT n_regionkey) FROM nation) / (SELECT count(DISTINCT n_regionkey) FROM nation))) AS BIGINT) AS est_size, least(cck, ock) AS ck, least(cnk, snk, nnk) AS nk FROM s)
SELECT est_size, least(ck, est_size) AS ndv_ck, least(nk, est_size) AS ndv_nk FROM r""",
    "estimate_semijoin_size_ndv": """
WITH s AS (
  SELECT (SELECT count(*) FROM supplier) AS s, (SELECT count(DISTINCT s_suppkey) FROM supplier) AS ssk, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS snk,
         (SELECT count(*) FROM nation) AS n, (SELECT count(DISTINCT n_nationkey) FROM nation) AS nnk, (SELECT count(DISTINCT n_regionkey) FROM nation) AS nrk)
SELECT least(s, greatest(1, ssk) * greatest(1, least(snk, nnk))) AS est_supplier, least(n, greatest(1, least(snk, nnk)) * greatest(1, nrk)) AS est_nation FROM s""",
    "yannakakis_chain_all": f"SELECT c_custkey AS ck, c_nationkey AS nk, o_orderkey AS ok, r_regionkey AS rk {_CHAIN_SQL} WHERE o_totalprice > 200000",
    "yannakakis_chain_reduced_root": f"SELECT r_regionkey AS rk FROM region x WHERE EXISTS (SELECT 1 {_CHAIN_SQL} WHERE o_totalprice > 480000 AND region.r_regionkey = x.r_regionkey)",
    "yannakakis_chain_fully_reduced_leaf": f"SELECT o_orderkey AS ok, o_custkey AS ck {_CHAIN_SQL} WHERE o_totalprice > 200000 AND r_name = 'EUROPE'",
    "yannakakis_bool_sat": f"SELECT EXISTS (SELECT 1 {_CHAIN_SQL} WHERE o_totalprice > 200000) AS satisfiable",
    "yannakakis_bool_unsat": f"SELECT EXISTS (SELECT 1 {_CHAIN_SQL} WHERE o_totalprice < 0) AS satisfiable",
    "cq_cycle_best": _CYCLE_BAG,
    "cq_cycle_bnb": _CYCLE_BAG,
    "cq_cycle_set": _CYCLE_SQL.format(d="DISTINCT"),
    "cq_cycle_full_reduction": _CYCLE_BAG,
    "cq_triangle_complete": """
SELECT a.l_orderkey AS ok, b.l_partkey AS pk, a.l_suppkey AS sk
FROM lineitem a JOIN lineitem c ON a.l_orderkey = c.l_orderkey JOIN lineitem b ON b.l_suppkey = a.l_suppkey AND b.l_partkey = c.l_partkey""",
    "shrink_soft_answers": _CYCLE_BAG,
    "shrink_hard_answers": _CYCLE_BAG,
    "decompositions_enum": """
SELECT CAST(a AS INTEGER) AS decomp_id, CAST(b AS INTEGER) AS node_id, CAST(c AS INTEGER) AS parent_id, d AS bag, e AS cover FROM (VALUES
(0, 0, -1, 'a,b', 'R'), (0, 1, 0, 'b,c', 'S'), (0, 2, 1, 'c,d', 'T'), (1, 0, -1, 'b,c', 'S'), (1, 1, 0, 'a,b', 'R'), (1, 2, 0, 'c,d', 'T'),
(2, 0, -1, 'c,d', 'T'), (2, 1, 0, 'b,c', 'S'), (2, 2, 1, 'a,b', 'R')) t(a, b, c, d, e)""",
    "fixture_case1": """SELECT * FROM (VALUES ('7', '9', '9', '4', '3', '8'), ('8', '9', '9', '4', '3', '8'), ('7', '3', '9', '8', '3', '8'), ('8', '3', '9', '8', '3', '8')) t("P", "U", "V", "W", "Y", "Z")""",
    "fixture_case2": """SELECT * FROM (VALUES ('1', '4', '8', '9', '9', '4', '3', '8'), ('1', '4', '8', '3', '9', '8', '3', '8')) t("A", "C", "P", "U", "V", "W", "Y", "Z")""",
    "fixture_case3": "SELECT false AS satisfiable",
    "load_csv_database": "SELECT * FROM (VALUES ('1', '2', '9'), ('', '01', '')) t(a, b, c)",
}
