"""Statistics by Spark aggregation, and size estimates of joins and semijoins.

Sizes and distinct counts are one aggregation per table. Histograms (value to frequency) stay DataFrames; a copy on the driver
is made only for columns with at most HELD distinct values, which is checked first; else estimates use distinct counts.
"""

from __future__ import annotations

import dataclasses
import functools
import logging
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD = 10_000
log = logging.getLogger(__name__)
#: Selectivities below count as none.
NONE = 1e-9


@dataclasses.dataclass(frozen=True)
class Statistics:
    """kind: "histogram" if every attribute has one, else "ndv"."""

    size: int
    ndv: dict[str, int]
    histograms: dict[str, dict] = dataclasses.field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.size < 0 or any(n < 0 for n in self.ndv.values()):
            raise ValueError("statistics can't be negative")
        if unknown := set(self.histograms) - set(self.ndv):
            raise ValueError(f"histograms of unknown attributes: {sorted(unknown)}")

    @property
    def kind(self) -> str:
        return "histogram" if set(self.histograms) == set(self.ndv) else "ndv"

    @property
    def columns(self) -> list[str]:
        return list(self.ndv)

    def frequency(self, attribute: str, value) -> int:
        return self.histograms.get(attribute, {}).get(value, 0)


# --- from data ---------------------------------------------------------------------------------------------------------


def size_and_ndv(df: DataFrame, approximate: float | None = None) -> DataFrame:
    """One row: size, and ndv_<column> of each column."""
    one = (lambda c: F.approx_count_distinct(c, approximate)) if approximate else F.count_distinct
    return df.agg(F.count(F.lit(1)).alias("size"), *[one(F.col(c)).alias(f"ndv_{c}") for c in df.columns])


def histogram(df: DataFrame, column: str) -> DataFrame:
    """value, freq."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("freq"))


def matching_rows(frames: Sequence[DataFrame], attribute: str) -> DataFrame:
    """value, freq: how many combinations of rows agree on each value of the attribute."""
    out = histogram(frames[0], attribute)
    for df in frames[1:]:
        other = histogram(df, attribute).withColumnRenamed("freq", "other")
        out = out.join(other, "value").select("value", (F.col("freq") * F.col("other")).alias("freq"))
    return out


def selectivity(frames: Sequence[DataFrame], attribute: str) -> DataFrame:
    """One row: matching (combinations of rows), selectivity (their share of all)."""
    total = frames[0].agg(F.count(F.lit(1)).cast("double").alias("t"))
    for i, df in enumerate(frames[1:]):
        total = total.crossJoin(df.agg(F.count(F.lit(1)).cast("double").alias(f"t{i}"))).withColumn("t", F.col("t") * F.col(f"t{i}")).select("t")
    matching = matching_rows(frames, attribute).agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("matching"))
    return matching.crossJoin(total).select("matching", F.when(F.col("t") > 0, F.col("matching") / F.col("t")).otherwise(0.0).alias("selectivity"))


def semijoin_selectivity(left: DataFrame, right: DataFrame, attribute: str) -> DataFrame:
    """One row: matching (left rows whose value occurs right), selectivity."""
    own = histogram(left, attribute)
    hit = own.join(histogram(right, attribute).select("value"), "value", "left_semi").agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("matching"))
    whole = own.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("t"))
    return hit.crossJoin(whole).select("matching", F.when(F.col("t") > 0, F.col("matching") / F.col("t")).otherwise(0.0).alias("selectivity"))


def collect(df: DataFrame, histograms: bool = False, approximate: float | None = None) -> Statistics:
    """histograms: of kind "histogram" if no column has more than HELD distinct values; else of kind "ndv", with a warning."""
    row = size_and_ndv(df, approximate).first()
    ndv = {c: row[f"ndv_{c}"] for c in df.columns}
    if not histograms:
        return Statistics(row["size"], ndv)
    if large := [c for c, n in ndv.items() if n > HELD]:
        log.warning("histograms of %s would have more than %d values: the statistics are of kind ndv", ", ".join(large), HELD)
        return Statistics(row["size"], ndv)
    held = {c: {r.value: r.freq for r in histogram(df.filter(F.col(c).isNotNull()), c).collect()} for c in df.columns}
    return Statistics(row["size"], ndv, held)


def collect_all(tables: Mapping[str, DataFrame], approximate: float | None = None) -> dict[str, Statistics]:
    """Sizes and distinct counts of several tables in one job."""
    names = list(tables)
    rows = [size_and_ndv(tables[n], approximate).select(F.lit(i).alias("i"), "size", F.array(*[f"ndv_{c}" for c in tables[n].columns]).alias("ndv")) for i, n in enumerate(names)]
    found = functools.reduce(DataFrame.union, rows).collect()
    return {names[r.i]: Statistics(r["size"], dict(zip(tables[names[r.i]].columns, r.ndv))) for r in found}


# --- estimates ---------------------------------------------------------------------------------------------------------


def _owners(stats: Sequence[Statistics]) -> dict[str, list[Statistics]]:
    out: dict[str, list[Statistics]] = {}
    for s in stats:
        for a in s.columns:
            out.setdefault(a, []).append(s)
    return out


def estimate_join(stats: Sequence[Statistics]) -> Statistics:
    """By histograms if all have them, else by distinct counts."""
    if not stats:
        raise ValueError("nothing to join")
    if len(stats) == 1:
        return stats[0]
    return _join_by_histograms(stats) if all(s.kind == "histogram" for s in stats) else _join_by_ndv(stats)


def _join_by_ndv(stats: Sequence[Statistics]) -> Statistics:
    """Product of sizes, divided for each shared attribute by all its distinct counts but the least (at least 1 each)."""
    rows = math.prod(s.size for s in stats)
    by, ndv = 1, {}
    for a, own in _owners(stats).items():
        counts = sorted(max(1, s.ndv[a]) for s in own)
        by *= math.prod(counts[1:])
        ndv[a] = counts[0] if len(own) > 1 else own[0].ndv[a]
    size = round(rows / by)
    return Statistics(size, {a: min(n, size) for a, n in ndv.items()})


def _join_by_histograms(stats: Sequence[Statistics]) -> Statistics:
    share, ndv, held = 1.0, {}, {}
    for a, own in _owners(stats).items():
        if len(own) == 1:
            ndv[a], held[a] = own[0].ndv[a], own[0].histograms[a]
            continue
        first = min((s.histograms[a] for s in own), key=len)
        both = {v: math.prod(s.frequency(a, v) for s in own) for v in first}
        held[a] = {v: n for v, n in both.items() if n}
        ndv[a] = len(held[a])
        combinations = math.prod(s.size for s in own)
        part = sum(held[a].values()) / combinations if combinations else 0.0
        share *= part if part >= NONE else 0.0
    size = round(share * math.prod(s.size for s in stats))
    # frequencies of other attributes don't hold for the result, so what follows is estimated by distinct counts
    return Statistics(size, {a: min(n, size) for a, n in ndv.items()})


def estimate_semijoin(left: Statistics, right: Statistics) -> Statistics:
    """Of the left side's size and attributes; as the left side is where no attribute is shared."""
    shared = [a for a in left.columns if a in right.ndv]
    if not shared:
        return left
    if left.kind == right.kind == "histogram":
        share, held = 1.0, dict(left.histograms)
        for a in shared:
            held[a] = {v: n for v, n in left.histograms[a].items() if right.frequency(a, v)}
            part = sum(held[a].values()) / left.size if left.size else 0.0
            share *= part if part >= NONE else 0.0
        size = round(share * left.size)
        return Statistics(size, {a: min(len(h), size) for a, h in held.items()})
    ndv = {a: max(1, min(n, right.ndv[a])) if a in shared else max(1, n) for a, n in left.ndv.items()}
    size = math.prod(ndv.values())
    return Statistics(size, ndv) if size <= left.size else Statistics(left.size, {a: min(n, left.ndv[a]) for a, n in ndv.items()})
