from __future__ import annotations

import random
from collections import Counter

import pytest

from treeline import cli
from treeline.engine import Query
from treeline.operators import relation as rel
from treeline.plans.decompose import decompositions
from treeline.plans.hypergraph import Hypergraph

GRAPHS = [
    "R(a,b), S(b,c), T(a,c).",
    "R(a,b), S(b,c), T(c,d), U(d,a).",
    "R(a,b,c), S(c,d), T(b,d), U(d).",
    "R(a,b), S(c), T(b,c,d).",
]


def flat(graph, tables):
    """The natural join row by row."""
    out = [({}, 1)]
    for e, variables in graph.edges.items():
        grown = []
        for have, _ in out:
            for row in tables[e]:
                new = dict(zip(variables, row))
                if all(have.get(k, v) == v for k, v in new.items()):
                    grown.append((have | new, 1))
        out = grown
    names = sorted(graph.vertices())
    return Counter(tuple(h[n] for n in names) for h, _ in out)


@pytest.mark.parametrize("text", GRAPHS)
def test_answers_equal_the_flat_join_as_bag_and_set(spark, text):
    rng = random.Random(text)
    graph = Hypergraph.parse(text)
    data = {e: [tuple(rng.choice("012") for _ in v) for _ in range(9)] for e, v in graph.edges.items()}
    want = flat(graph, data)
    tables = {e: rel.relation(spark, v, data[e]) for e, v in graph.edges.items()}
    for mode, shrink in (("best", None), ("bnb", "hard")):
        q = Query(graph, tables, mode=mode, shrink=shrink)
        assert Counter(map(tuple, q.answers().collect())) == want
        assert q.satisfiable() == bool(want)
    plans = list(decompositions(graph, 2, limit=40))
    for plan in rng.sample(plans, min(3, len(plans))):
        q = Query(graph, tables)
        assert Counter(map(tuple, q.answers(plan=plan, reduce=rng.choice(["none", "up", "full"])).collect())) == want
    assert Counter(map(tuple, q.answers("set").collect())) == Counter(list(want))


def test_tables_must_fit_the_query(spark):
    r = rel.relation(spark, ["a", "b"])
    with pytest.raises(KeyError):
        Query("R(a,b), S(b,c).", {"R": r})
    with pytest.raises(ValueError):
        Query("R(a,c).", {"R": r})
    with pytest.raises(ValueError):
        Query("R(a,b).", {"R": r}).answers("list")


def test_filters_and_columns_reach_the_scan(spark):
    from treeline.queries import chain

    plan = chain(spark, "/root/testdata/sf0.001", reduce="none").all_answers()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,200000.0)" in plan
    assert "c_name" not in plan and "o_orderdate" not in plan


def test_command_line(spark, tmp_path, capsys):
    graph, db, stats = tmp_path / "g.txt", tmp_path / "db.csv", tmp_path / "s.csv"
    graph.write_text("R(a,b), S(b,c), T(a,c).")
    db.write_text("r,R,a,b\nt,1,2\nr,S,b,c\nt,2,3\nr,T,a,c\nt,1,3\n")
    stats.write_text("size,R,10\nsize,S,20\nsize,T,30\n")
    assert cli.main(["-graph", str(graph), "-width", "2", "-enum", "2", "-gml", str(tmp_path / "out")]) == 0
    assert "2 decompositions were found" in capsys.readouterr().out
    assert (tmp_path / "out_1.gml").read_text().startswith("graph [")
    cli.main(["-graph", str(graph), "-width", "2", "-mode", "best", "-evaldb", str(db), "-shrink", "hard"])
    assert "Cost:" in capsys.readouterr().out
    cli.main(["-graph", str(graph), "-width", "2", "-mode", "bnb", "-evaljoin", str(stats), "-complete", "-timeout", "60000"])
    assert "BnbDetK" in capsys.readouterr().out
    for bad in (["-width", "0"], ["-width", "1", "-mode", "best"], ["-width", "1", "-evaldb", "x", "-evaljoin", "y"], ["-width", "1", "-shrink", "firm"]):
        with pytest.raises(SystemExit):
            cli.main(["-graph", str(graph), *bad])
