from __future__ import annotations

import pytest

from treeline.operators import relation as rel
from treeline.operators.yannakakis import Yannakakis, tree
from treeline.queries import CASE1, CASE2, CASE3, fixture
from treeline.sources.tables import stored


def named(tree):
    return {k: sorted(map(tuple, df.collect())) for k, df in tree.named().items()}


# What the phases leave of the three cases, and their answers.
ALL_R = [("3", "8", "3"), ("3", "8", "4"), ("3", "8", "9"), ("8", "3", "8"), ("8", "9", "4"), ("9", "3", "8"), ("9", "4", "7")]
UP_R = [("3", "8", "3"), ("3", "8", "9"), ("8", "3", "8"), ("9", "3", "8")]
UP_1 = {"d": [("3", "7"), ("3", "8")], "r": UP_R, "s": ALL_R, "t": [("9", "3"), ("9", "5"), ("9", "8")]}
DOWN_R, DOWN_S, DOWN_T = [("3", "8", "3"), ("3", "8", "9")], [("8", "3", "8"), ("8", "9", "4")], [("9", "8")]
DOWN_1 = {"d": [("3", "7"), ("3", "8")], "r": DOWN_R, "s": DOWN_S, "t": DOWN_T}
ANSWERS_1 = [("7", "3", "9", "8", "3", "8"), ("7", "9", "9", "4", "3", "8"), ("8", "3", "9", "8", "3", "8"), ("8", "9", "9", "4", "3", "8")]
UP_2 = {"d": [("3", "8")], "r": UP_R, "a": [("3", "5"), ("8", "4")], "b": [("3", "2"), ("4", "1"), ("5", "4")], "s": ALL_R, "t": UP_1["t"]}
DOWN_2 = {"d": [("3", "8")], "r": DOWN_R, "a": [("8", "4")], "b": [("4", "1")], "s": DOWN_S, "t": DOWN_T}
ANSWERS_2 = [("1", "4", "8", "3", "9", "8", "3", "8"), ("1", "4", "8", "9", "9", "4", "3", "8")]


def test_case1_phases(spark):
    y = fixture(spark, CASE1)
    assert named(y.reduced()) == UP_1 and named(y.fully_reduced()) == DOWN_1
    for reduce in ("none", "up", "full"):
        out = fixture(spark, CASE1, reduce).all_answers()
        assert out.columns == ["P", "U", "V", "W", "Y", "Z"] and sorted(map(tuple, out.collect())) == ANSWERS_1
    assert y.bool_answer()


def test_case2_phases(spark):
    y = fixture(spark, CASE2)
    assert named(y.reduced()) == UP_2 and named(y.fully_reduced()) == DOWN_2
    assert sorted(map(tuple, y.all_answers().collect())) == ANSWERS_2


def test_stored_passes_read_each_node_once_and_stop_at_an_empty_root(spark):
    for case, want in ((CASE1, ANSWERS_1), (CASE2, ANSWERS_2), (CASE3, [])):
        root = fixture(spark, case).root
        y = Yannakakis(root, "full", stored(spark))
        out = y.all_answers()
        assert sorted(map(tuple, out.collect())) == want
        n = len(list(root.nodes()))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") == (n if want else 0) and out.columns == fixture(spark, case).all_answers().columns


def test_case3_is_unsatisfiable_with_the_full_schema(spark):
    y = fixture(spark, CASE3)
    assert not y.bool_answer() and not y.satisfiable().first().satisfiable
    out = y.all_answers()
    assert out.columns == ["P", "U", "V", "W", "Y", "Z"] and out.isEmpty()


def test_an_empty_node_apart_from_its_parent_makes_no_answers(spark):
    root = tree("a", rel.relation(spark, ["x"], [("1",)]), tree("b", rel.relation(spark, ["y"])))
    assert not Yannakakis(root).bool_answer() and Yannakakis(root).all_answers().isEmpty()
    assert not Yannakakis(root).satisfiable().first()[0]


def test_nodes_with_several_relations(spark):
    a, b, c = rel.relation(spark, ["x", "y"], [("1", "2"), ("1", "3")]), rel.relation(spark, ["y", "z"], [("2", "5")]), rel.relation(spark, ["z"], [("5",), ("5",)])
    out = Yannakakis(tree("n", [a, b], tree("c", c))).all_answers(["z", "x"])
    assert [tuple(r) for r in out.collect()] == [("5", "1")] * 2


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        Yannakakis(tree("a", rel.relation(spark, ["x"])), "some")
