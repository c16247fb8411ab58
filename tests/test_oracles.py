"""Every engine query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from treeline.plans.decompose import decompositions
from treeline.queries import ORACLES, QUERIES, cycle

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{D}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, D)
    want = duck.execute(ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() == 235


def second_cost(edges, node):
    """Cost, size and distinct counts of a node, written anew from the statistics."""
    covers = [edges[e] for e in node.cover]
    size, ndv = math.prod(s.size for s in covers), {}
    for a in {a for s in covers for a in s.ndv}:
        counts = sorted(max(1, s.ndv[a]) for s in covers if a in s.ndv)
        size /= math.prod(counts[1:])
        ndv[a] = counts[0] if len(counts) > 1 else next(s.ndv[a] for s in covers if a in s.ndv)
    size = round(size)
    ndv = {a: min(n, size) for a, n in ndv.items()}
    cost = size
    for child in node.children:
        below, _, other = second_cost(edges, child)
        if set(ndv) & set(other):
            new = {a: max(1, min(n, other.get(a, n))) for a, n in ndv.items()}
            product = math.prod(new.values())
            ndv = new if product <= size else {a: min(n, ndv[a]) for a, n in new.items()}
            size = min(size, product)
        cost += below + size
    return cost, size, ndv


def test_ranking_has_all_trees_with_their_costs(spark):
    rows = QUERIES["cost_ranking_cycle"](spark, D).orderBy("rank").collect()
    q = cycle(spark, D)
    want = {str(t): second_cost(q.costs().edges, t.root)[0] for t in decompositions(q.graph, 2)}
    assert len(want) > 200 and {r.tree: r.cost for r in rows} == want
    assert [r.cost for r in rows] == sorted(want.values())
    assert rows[0].cost == q.costs().cost(q.plan())


def test_all_queries_are_registered():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
