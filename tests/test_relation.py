from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from treeline.operators import relation as rel


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def left(spark):
    return rel.relation(spark, ["a", "b"], [("1", "x"), ("1", "x"), ("2", ""), ("01", "y")])


@pytest.fixture(scope="module")
def right(spark):
    return rel.relation(spark, ["b", "c"], [("x", "p"), ("x", "q"), ("", "r"), ("z", "s")])


def test_natural_join_is_a_bag_and_empty_strings_match(left, right):
    out = rel.natural_join(left, right)
    assert out.columns == ["a", "b", "c"]
    assert rows(out) == Counter({("1", "x", "p"): 2, ("1", "x", "q"): 2, ("2", "", "r"): 1})


def test_join_on_equal_schemas_multiplies(left):
    assert rows(rel.natural_join(left, left))["1", "x"] == 4


def test_product_without_common_attributes(spark, left):
    other = rel.relation(spark, ["k"], [("1",), ("2",)])
    assert sum(rows(rel.natural_join(left, other)).values()) == 8


def test_values_compare_byte_for_byte(spark):
    a, b = rel.relation(spark, ["v"], [("1",), ("01",)]), rel.relation(spark, ["v"], [("1.0",), ("01",)])
    assert rows(rel.natural_join(a, b)) == Counter([("01",)])


def test_semijoin_keeps_left_duplicates(left, right):
    assert rows(rel.semijoin(left, right)) == Counter({("1", "x"): 2, ("2", ""): 1})


def test_semijoin_without_common_attributes_gives_left_even_for_empty_right(spark, left):
    assert rows(rel.semijoin(left, rel.relation(spark, ["k"]))) == rows(left)


def test_select_reports_whether_rows_went(left):
    kept, gone = rel.select(left, F.col("a") == "1", report=True)
    assert rows(kept) == Counter({("1", "x"): 2}) and gone
    assert not rel.select(left, F.lit(True), report=True)[1]


def test_project_and_rename(left):
    assert rows(rel.project(left, ["a"])) == Counter([("1",), ("2",), ("01",)])
    assert rel.rename(left, {"b": "z"}).columns == ["z"]


def test_relations_refuse_bad_schemas_and_rows(spark):
    for attributes, given in (([], []), (["a", "a"], []), (["a"], [("1", "2")])):
        with pytest.raises(ValueError):
            rel.relation(spark, attributes, given)


def test_append_size_position(left):
    assert rel.size(rel.append(left, [("9", "9")])) == 5
    assert rel.position(left, "b") == 1 and rel.position(left, "q") is None


def test_same_bag_counts_multiplicities(spark):
    a, b = rel.relation(spark, ["v"], [("a",), ("a",), ("b",)]), rel.relation(spark, ["v"], [("a",), ("b",), ("b",)])
    assert not rel.same_bag(a, b) and rel.same_bag(a, a)


def test_types_that_do_not_compare_are_refused(spark, left):
    with pytest.raises(TypeError):
        rel.natural_join(left, spark.range(3).select(F.col("id").alias("a")))


def test_join_all_avoids_products(spark):
    a, b, c = (rel.relation(spark, x, [("1", "1")]) for x in (["a", "b"], ["c", "d"], ["b", "c"]))
    assert rel.join_all([a, b, c]).columns == ["a", "b", "c", "d"]
    assert rel.attributes_of([a, c])[0] == ["a", "b", "c"]


def test_a_relation_given_twice_or_thrice_is_joined_as_often(left, right):
    for n in (2, 3):
        want = left
        for _ in range(n):
            want = rel.natural_join(want, right)
        assert rows(rel.join_all([left, *[right] * n])) == rows(want)
    assert sum(rows(rel.join_all([left, left, left])).values()) == 8 + 1 + 1
