"""Control files: databases and statistics as ragged CSV.

A database has records r,<name>,<attribute>... that open a relation and t,<value>... that add a row to the relation opened last;
a name that comes again replaces its earlier relation. Statistics have size,<edge>...,<int> and ndv,<edge>...,<column>,<int>;
other tags are passed over, but their last field must be an integer too. All values are strings; an empty field is the
empty string, never null.
"""

from __future__ import annotations

import csv
import io
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import Statistics, estimate_join
from ..operators.relation import check_names
from ..plans.hypergraph import Hypergraph

def parse_database(text: str) -> dict[str, tuple[list[str], list[list[str]]]]:
    out: dict[str, tuple[list[str], list[list[str]]]] = {}
    current = None
    for n, record in enumerate(csv.reader(io.StringIO(text)), 1):
        if not record:
            continue
        kind, *rest = record
        if kind == "r":
            if not rest:
                raise ValueError(f"record {n}: a relation needs a name")
            check_names(rest[1:])
            current = out[rest[0]] = (rest[1:], [])
        elif kind == "t":
            if current is None:
                raise ValueError(f"record {n}: a row before any relation")
            if len(rest) != len(current[0]):
                raise ValueError(f"record {n}: {len(rest)} values for {len(current[0])} attributes")
            current[1].append(rest)
        else:
            raise ValueError(f"record {n}: unknown kind {kind!r}")
    return out


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of any file system that Spark reads."""
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def records(spark: SparkSession, path: str) -> DataFrame:
    """n (ascending in file order), record: the records of one CSV file, empty lines left out. A line break inside quotes belongs to
    its field: a line begins a record if the lines before it hold an even number of quotes. The quotes of whole partitions are
    counted first (a number for each on the driver), so a large file is split among tasks."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    lines = lines.withColumns({"part": F.shiftright("n", 33), "quotes": F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))})
    before, total = {}, 0
    for r in lines.groupBy("part").agg(F.sum("quotes").alias("k")).orderBy("part").collect():
        before[r.part], total = total, total + r.k
    if not total:
        return lines.filter("line <> ''").select("n", F.col("line").alias("record"))
    if total % 2:
        raise ValueError("a quoted field has no end")
    odd = [p for p, k in before.items() if k % 2]
    order = Window.partitionBy("part").orderBy("n")
    open_before = F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("part").isin(odd).cast("int")
    lines = lines.withColumn("begins", open_before % 2 == 0)
    # a record that goes on in the next partition begins at the last line, before it, that begins one
    heads = {r.part: r.n for r in lines.filter("begins").groupBy("part").agg(F.max("n").alias("n")).collect()}
    carried, last = {}, None
    for p in sorted(before):
        carried[p] = last
        last = heads.get(p, last)
    of_part = F.create_map(*[F.lit(x) for p, n in carried.items() if n is not None for x in (p, n)] or [F.lit(-1), F.lit(-1)])
    first = F.max(F.when(F.col("begins"), F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = lines.withColumn("first", F.coalesce(first, F.element_at(of_part, F.col("part"))))
    alone = lines.filter("begins and quotes % 2 = 0").select("n", F.col("line").alias("record"))
    joined = lines.filter("not begins or quotes % 2 = 1").groupBy("first").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("x"))
    joined = joined.select(F.col("first").alias("n"), F.array_join(F.col("x.line"), "\n").alias("record"))
    return alone.union(joined).filter("record <> ''")


def load_database(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The relations of a database file of any size, each the range of t records after its own r record. Only the r records come to
    the driver (one for each relation). A row with too few or too many values is refused when its relation is read."""
    found = records(spark, path)
    odd = found.filter(~F.col("record").rlike("^[rt],")).orderBy("n").first()
    if odd is not None:
        raise ValueError(f"unknown kind in {odd.record[:80]!r}")
    heads = [(r.n, next(csv.reader(io.StringIO(r.record)))[1:]) for r in found.filter("record like 'r,%'").orderBy("n").collect()]
    first = found.filter("record like 't,%'").agg(F.min("n")).first()[0]
    if first is not None and (not heads or first < heads[0][0]):
        raise ValueError("a row before any relation")
    out = {}
    for i, (n, (name, *attributes)) in enumerate(heads):
        check_names(attributes)
        end = heads[i + 1][0] if i + 1 < len(heads) else 1 << 62
        rows = found.filter(F.col("n").between(n + 1, end - 1))
        schema = ", ".join(f"`{a}` string" for a in ("__kind", *attributes))
        options = {"nullValue": "\u0000", "emptyValue": "", "mode": "FAILFAST", "escape": '"', "maxCharsPerColumn": "-1"}
        parsed = rows.select(F.from_csv("record", schema, options).alias("x"))
        out[name] = parsed.select(*[F.coalesce(F.col("x")[a], F.lit("")).alias(a) for a in attributes])
    return out


def parse_statistics(text: str, graph: Hypergraph) -> tuple[dict[str, Statistics], dict[frozenset[str], int]]:
    """Statistics of single edges, and given sizes of joins of several. A column without a count has the edge's size."""
    sizes: dict[frozenset[str], int] = {}
    ndv: dict[tuple[frozenset[str], str], int] = {}
    for n, record in enumerate(csv.reader(io.StringIO(text)), 1):
        if not record:
            continue
        tag, *rest = record
        try:
            number = int(rest[-1])
        except (IndexError, ValueError):
            raise ValueError(f"record {n}: the last field must be an integer") from None
        names = rest[:-1] if tag == "size" else rest[:-2]
        if tag not in ("size", "ndv"):
            continue
        if number < 0 or not names or (unknown := [e for e in names if e not in graph.edges]):
            raise ValueError(f"record {n}: {'unknown edge ' + unknown[0] if number >= 0 and names else 'bad record'}")
        key = frozenset(names)
        if tag == "size":
            sizes[key] = number
        else:
            if rest[-2] not in graph.vertices(key):
                raise ValueError(f"record {n}: {rest[-2]} is no vertex of {', '.join(names)}")
            ndv[key, rest[-2]] = number
    single = {}
    for e, variables in graph.edges.items():
        key = frozenset((e,))
        if key in sizes:
            single[e] = Statistics(sizes[key], {v: ndv.get((key, v), sizes[key]) for v in variables})
    return single, {k: n for k, n in sizes.items() if len(k) > 1}


def load_statistics(spark: SparkSession, path: str, graph: Hypergraph) -> tuple[dict[str, Statistics], dict[frozenset[str], int]]:
    return parse_statistics(read_text(spark, path), graph)


def differing_estimates(single: dict[str, Statistics], joins: dict[frozenset[str], int]) -> dict[frozenset[str], tuple[int, int]]:
    """Given sizes that the estimate from single edges doesn't confirm: (given, estimated)."""
    out = {}
    for key, given in joins.items():
        if all(e in single for e in key):
            made = estimate_join([single[e] for e in sorted(key)]).size
            if not math.isclose(made, given):
                out[key] = (given, made)
    return out
