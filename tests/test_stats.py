from __future__ import annotations

import csv
import io

import pytest

from treeline.functions import stats
from treeline.functions.stats import Statistics, estimate_join, estimate_semijoin
from treeline.operators import relation as rel
from treeline.plans.hypergraph import Hypergraph
from treeline.sources.csv_files import differing_estimates, load_database, load_statistics, parse_database, parse_statistics


def test_collect_counts_rows_values_and_frequencies(spark):
    df = rel.relation(spark, ["a", "b"], [("1", "x"), ("1", "y"), ("2", "y")])
    got = stats.collect(df, histograms=True)
    assert got == Statistics(3, {"a": 2, "b": 2}, {"a": {"1": 2, "2": 1}, "b": {"x": 1, "y": 2}}) and got.kind == "histogram"
    assert got.frequency("a", "1") == 2 and got.frequency("a", "9") == 0
    assert stats.collect(df).kind == "ndv"
    assert stats.collect(df, approximate=0.05).size == 3


def test_histogram_estimates_are_exact_for_one_attribute(spark):
    a = rel.relation(spark, ["k"], [("1",), ("1",), ("2",)])
    b = rel.relation(spark, ["k"], [("1",), ("2",), ("2",), ("3",)])
    sa, sb = (stats.collect(x, histograms=True) for x in (a, b))
    assert estimate_join([sa, sb]).size == rel.natural_join(a, b).count() == 4
    assert estimate_semijoin(sb, sa).size == rel.semijoin(b, a).count() == 3
    row = stats.selectivity([a, b], "k").first()
    assert row.matching == 4 and row.selectivity == 4 / 12
    row = stats.semijoin_selectivity(b, a, "k").first()
    assert row.matching == 3 and row.selectivity == 3 / 4


def test_ndv_estimates():
    r, s, t = Statistics(100, {"a": 5, "b": 10}), Statistics(60, {"a": 3, "c": 6}), Statistics(40, {"a": 4})
    out = estimate_join([r, s, t])
    assert out.size == 100 * 60 * 40 // 20 and out.ndv["a"] == 3  # by 5 * 4, all but the least
    assert estimate_semijoin(r, s).size == 30
    assert estimate_semijoin(Statistics(20, {"a": 5, "b": 10}), s).size == 20
    assert estimate_semijoin(r, Statistics(1, {"z": 1})) == r


def test_mixed_statistics_fall_back_to_distinct_counts():
    h = Statistics(4, {"a": 2}, {"a": {1: 2, 2: 2}})
    assert estimate_join([h, Statistics(10, {"a": 5})]).size == 8


def test_zero_counts_divide_by_one():
    assert estimate_join([Statistics(3, {"a": 0}), Statistics(3, {"a": 0})]).size == 9
    with pytest.raises(ValueError):
        Statistics(-1, {})


def test_database_files(spark, tmp_path):
    text = 'r,R,a,b\nt,1,2\n\nt,,"x,y"\nr,S,b,c\nt,2,9\nr,R,a\nt,7\n'
    assert parse_database(text) == {"R": (["a"], [["7"]]), "S": (["b", "c"], [["2", "9"]])}
    path = tmp_path / "db.csv"
    path.write_text(text := 'r,R,a,b\nt,1,2\n\nt,,"x,y"\nt,"two\nlines ""q""\n\nmore", z\nr,S,b,c\nt,2,9\n')
    loaded, parsed = load_database(spark, str(path)), parse_database(text)
    assert set(loaded) == set(parsed)
    for name, (attributes, rows) in parsed.items():
        assert loaded[name].columns == attributes and sorted(map(list, loaded[name].collect())) == sorted(rows)
    path.write_text("r,R,a,b\nt,1\n")
    with pytest.raises(Exception, match="MALFORMED"):
        load_database(spark, str(path))["R"].collect()
    for bad in ("t,1\n", "q,1\n", 'r,R,a\nt,"1\n'):
        path.write_text(bad)
        with pytest.raises(ValueError):
            load_database(spark, str(path))
    for bad in ("t,1\n", "r,R,a\nt,1,2\n", "q,1\n", "r,R\n", "r,R,a,a\n"):
        with pytest.raises(ValueError):
            parse_database(bad)


def test_statistics_files(spark, tmp_path):
    g = Hypergraph.parse("R(a,b), S(b,c).")
    path = tmp_path / "stats.csv"
    path.write_text("size,R,100\nndv,R,a,10\nsize,S,50\nndv,S,b,5\nsize,R,S,500\nother,1\n")
    single, joins = load_statistics(spark, str(path), g)
    assert single["R"] == Statistics(100, {"a": 10, "b": 100}) and joins == {frozenset("RS"): 500}
    assert differing_estimates(single, joins) == {frozenset("RS"): (500, 50)}
    for bad in ("size,R,x\n", "size,Q,1\n", "ndv,R,z,1\n", "size,R,-1\n", "other,x\n"):
        with pytest.raises(ValueError):
            parse_statistics(bad, g)


def test_records_go_on_across_partitions(spark, tmp_path):
    rows = [[str(i), "line\n" * (i % 7) + 'x"y' * (i % 3)] for i in range(400)]
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["r", "R", "a", "b"])
    w.writerows(["t", *r] for r in rows)
    path = tmp_path / "db.csv"
    path.write_text(out.getvalue())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "37")
        assert sorted(map(list, load_database(spark, str(path))["R"].collect())) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_too_many_values_for_a_histogram_are_told(spark, monkeypatch, caplog):
    monkeypatch.setattr(stats, "HELD", 2)
    df = rel.relation(spark, ["a"], [("1",), ("2",), ("3",)])
    assert stats.collect(df, histograms=True).kind == "ndv" and "histograms of a" in caplog.text
