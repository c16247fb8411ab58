"""Relations: joins, semijoins, selection, projection and comparison by attribute names.

A relation is a DataFrame without repeated column names; it is a bag of rows in no order. Every join is by the names that both
sides have. Results always have an explicit column order: the left side's columns, then the right side's new ones.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def check_names(columns: Sequence[str]) -> None:
    if not columns:
        raise ValueError("a relation needs an attribute at least")
    if len(set(columns)) < len(columns):
        raise ValueError(f"attribute names repeat: {list(columns)}")


def relation(spark: SparkSession, attributes: Sequence[str], rows: Iterable[Sequence[str]] = ()) -> DataFrame:
    """A small relation of strings from the driver. Rows of another length are refused."""
    check_names(attributes)
    rows = [tuple(r) for r in rows]
    for r in rows:
        if len(r) != len(attributes):
            raise ValueError(f"{r} has {len(r)} values for {len(attributes)} attributes")
    return spark.createDataFrame(rows, T.StructType([T.StructField(a, T.StringType()) for a in attributes]))


def append(df: DataFrame, rows: Iterable[Sequence[str]]) -> DataFrame:
    return df.unionByName(relation(df.sparkSession, df.columns, rows))


def size(df: DataFrame) -> int:
    return df.count()


def position(df: DataFrame, attribute: str) -> int | None:
    return df.columns.index(attribute) if attribute in df.columns else None


def common(left: DataFrame, right: DataFrame) -> list[str]:
    there = set(right.columns)
    return [c for c in left.columns if c in there]


def attributes_of(relations: Sequence) -> tuple[list[str], dict[str, list]]:
    """Attributes in the order first seen, and for each the relations that have it."""
    owners: dict[str, list] = {}
    for r in relations:
        for a in r.columns:
            owners.setdefault(a, []).append(r)
    return list(owners), owners


def check_types(left: DataFrame, right: DataFrame) -> None:
    """Join variables must have types that compare without a cast that can fail."""
    for c in common(left, right):
        a, b = left.schema[c].dataType, right.schema[c].dataType
        if a != b and not (isinstance(a, T.NumericType) and isinstance(b, T.NumericType)):
            raise TypeError(f"{c} is {a.simpleString()} on one side and {b.simpleString()} on the other")


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that agree on all common attributes, with multiplicities m * n; the product where there are none.

    Spark picks the algorithm: a hash join against a broadcast side if its statistics say that it is small, else sort-merge,
    with skewed partitions split at run time.
    """
    check_types(left, right)
    on = common(left, right)
    new = [c for c in right.columns if c not in set(on)]
    if not on:
        log.warning("no common attribute: the join of %s and %s is their product", left.columns, right.columns)
        return left.crossJoin(right).select(*left.columns, *new)
    return left.join(right, on, "inner").select(*left.columns, *new)


def join_all(relations: Sequence[DataFrame]) -> DataFrame:
    """Left-deep natural join in an order that keeps to common attributes where it can, so that no product is made for the order's
    sake. A relation that is given several times is joined as often."""
    if not relations:
        raise ValueError("nothing to join")
    rest, out = list(relations[1:]), relations[0]
    while rest:
        at = next((i for i, r in enumerate(rest) if common(out, r)), 0)
        out = natural_join(out, rest.pop(at))
    return out


def semijoin(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows, duplicates too, with a partner; all of them where there is no common attribute, even if right is empty."""
    on = common(left, right)
    if not on:
        return left
    check_types(left, right)
    return left.join(right.select(*on), on, "left_semi").select(*left.columns)


def select(df: DataFrame, condition: Column | str, report: bool = False):
    """Rows for which the condition is true; with report also whether any row went (this counts, in one more job each)."""
    kept = df.filter(condition)
    return (kept, df.count() != kept.count()) if report else kept


def project(df: DataFrame, attributes: Sequence[str], distinct: bool = True) -> DataFrame:
    out = df.select(*attributes)
    return out.distinct() if distinct else out


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Binds columns to variables: keeps the columns that names has, under their new names."""
    out = df.select(*[df[c].alias(v) for c, v in names.items()])
    check_names(out.columns)
    return out


def same_bag(a: DataFrame, b: DataFrame) -> bool:
    """Equal rows with equal multiplicities; the order of rows and of attributes doesn't matter."""
    if set(a.columns) != set(b.columns):
        return False
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """For small relations: the same attributes in the same order and the same rows, sorted."""
    return a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
