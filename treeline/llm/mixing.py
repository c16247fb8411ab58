"""Mixing sources to target weights.

Every document gets a hash-random key; a source's documents are put in key order by equal ranges of keys (keys are uniform,
so the ranges are even and one large source is spread over all of them); prefix sums of word counts run within ranges and,
over one row per range, across them; each source is cut at its budget of words, in whole epochs and a last partial one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, table

WEIGHTS = (5, 2, 1)
CAP = 3
#: Hex digits of the key that name its range: 3 for 4096 ranges a source.
RANGE_DIGITS = 3


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> with target: the share of all sizes by weight, none above cap times its source's size.

    One row per source. A source is at its cap if cap * size / weight is at most the level that fills up the rest; in the
    order of that ratio those sources come first, and the level follows from two prefix sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy((cap * F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    place = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (place + 1).cast("int")).cast("long")
    level = sizes.withColumn("w", w).withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)))
    level = level.withColumn("rest_w", F.sum("w").over(after)).withColumn("nth", F.row_number().over(ratio))
    full = F.col("source_size") * cap * F.col("rest_w") <= F.col("rest") * F.col("w")
    level = level.withColumn("first", F.min(F.when(~full, F.struct("nth", "rest", "rest_w"))).over(every))
    capped = F.col("first").isNull() | (F.col("nth") < F.col("first.nth"))
    share = (F.col("first.rest") * F.col("w")).cast("double") / F.col("first.rest_w").cast("double")
    return level.select("source", "source_size", F.when(capped, (cap * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def _key():
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(text)))


def _name(column: str = "source"):
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit("n"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, keys: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), epochs (whole takes), part (words of the last take).

    Nulls: a null text has size 0; a null source is a source of its own; a null doc_id is a value like others. Repeated rows
    count each by itself. A source without words has target 0 and nothing taken. An empty table gives no rows. Ties in the
    key are between rows equal in doc_id and text; which of them comes first doesn't change the rows returned. Other columns
    are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", "source", n_words().alias("size"), _key().alias("key"), _name().alias("name"))
    rows = scratch.keep(rows.withColumn("part", F.substring("key", 1, RANGE_DIGITS)))
    ranges = rows.groupBy("name", "source", "part").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    sizes = rows.groupBy("name", "source").agg(F.sum("size").alias("source_size"))
    aims = targets(sizes.select("source", "source_size"), weights, cap).withColumn("name", _name()).drop("source")
    ranges = ranges.drop("source", "range_size").join(aims, "name")
    inside = Window.partitionBy("name", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = rows.join(ranges, ["name", "part"]).withColumn("start", start)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    last = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("epochs") * F.col("source_size") - F.col("start")))
    out = placed.withColumn("epochs", epochs).withColumn("part_words", last.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part_words")).alias("taken"), "epochs", "part_words", *(("name", "key") if keys else ()))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents of the mix, with the columns of docs: each as often as its source's whole epochs, and once more, cut after
    its last word in budget, where its last take is partial (one document a source). Nulls and ties as in mix(); of rows equal
    in doc_id, source and text, as many get a last take as mix() gives them. Null texts have no words and come as often as their
    source's whole epochs; an empty table gives no rows; texts of any length stay whole but for the one that is cut."""
    columns = docs.columns
    plan = mix(docs, weights, cap, keys=True)
    same = ["__name", "__key"]
    plan = plan.groupBy(F.col("name").alias("__name"), F.col("key").alias("__key")).agg(F.first("epochs").alias("__epochs"), F.sum("part_words").alias("__part"))
    named = docs.withColumns({"__name": _name(), "__key": _key(), "__size": n_words()})
    named = named.withColumn("__nth", F.row_number().over(Window.partitionBy(*same).orderBy("__size")))
    rows = named.join(plan, same)
    left = F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__part") - (F.col("__nth") - 1) * F.col("__size"))).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), left), "")
    last = F.when(left == 0, F.array().cast("array<string>")).when(left == F.col("__size"), F.array("text")).otherwise(F.array(cut))
    whole = F.array_repeat(F.col("text"), F.col("__epochs").cast("int"))
    return rows.withColumn("text", F.explode(F.concat(whole, last))).select(*columns)


def op1_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][nth % 3 + 1] AS BIGINT) AS w FROM s),
r AS (
  SELECT *, row_number() OVER o AS place, CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
         CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest_w
  FROM w WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST)),
f AS (SELECT place, rest, rest_w FROM r WHERE 3 * source_size * rest_w > rest * w ORDER BY place LIMIT 1),
t AS (
  SELECT r.source, r.source_size,
         CASE WHEN f.place IS NULL OR r.place < f.place THEN CAST(3 * r.source_size AS DOUBLE)
              ELSE CAST(f.rest * r.w AS DOUBLE) / CAST(f.rest_w AS DOUBLE) END AS target
  FROM r LEFT JOIN f ON true),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN CAST(0 AS BIGINT)
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) END AS taken
FROM p
"""
