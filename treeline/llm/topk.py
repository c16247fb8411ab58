"""Exact top-k by inner product: ball trees on shards, searched by branch and bound.

Vectors go to shards around centres (large cells are dealt into several shards by hash; there is a fixed number of shards at
most). A query first searches the shard whose bound is highest, and takes its kth score along as the score to beat to the few
next ones, and the best one of all so far to the rest, as far as their bounds aren't below it. In a shard, nodes come in the order of their upper bound (inner product
with the ball's centre plus radius times the query's length), and the search ends at the first bound below the kth score.
Scores are integers, compared exactly; a bound is rounded up by more than its error.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import MOST_CELLS, SAMPLE, centres, finite, nearest
from .common import Scratch, table, with_uid

K, SCALE, EVERY = 10, 1024, 100
SHARD, MOST_SHARDS, LEAF = 8192, 1 << 16, 64
#: Queries that meet one copy of a shard; a shard that more are routed to is copied for each so many.
BLOCK = 1 << 16
#: Shards that a query has gone to after each round, in the order of their bounds.
ROUNDS = (1, 5, None)
_EXACT = 2.0**53
_LONG = 2**63 - 1


class BallTree:
    """Integer-valued vectors (float64) in leaves of LEAF; bounds of all nodes for a query come from one product."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.order = np.arange(len(vectors))
        centre, radius, self.span, self.child = [], [], [], []
        stack = [(0, len(vectors), -1)]
        while stack:
            lo, hi, parent = stack.pop()
            own = vectors[self.order[lo:hi]]
            mid = own.mean(axis=0)
            node = len(centre)
            centre.append(mid)
            radius.append(float(np.sqrt(((own - mid) ** 2).sum(axis=1).max())))
            self.span.append((lo, hi))
            self.child.append([])
            if parent >= 0:
                self.child[parent].append(node)
            if hi - lo > LEAF and radius[-1] > 0:
                far = own[np.argmax(((own - mid) ** 2).sum(axis=1))]
                other = own[np.argmax(((own - far) ** 2).sum(axis=1))]
                half = (hi - lo) // 2
                split = np.argpartition(own @ (other - far), half)
                self.order[lo:hi] = self.order[lo:hi][split]
                stack += [(lo, lo + half, node), (lo + half, hi, node)]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.size = np.sqrt((self.centre**2).sum(axis=1)) + self.radius
        self.vectors = vectors[self.order]
        self.longest = float(np.sqrt((vectors**2).sum(axis=1)).max())

    def scores(self, lo: int, hi: int, query: np.ndarray, exact: bool) -> list[int]:
        if exact:
            return (self.vectors[lo:hi] @ query).astype(np.int64).tolist()
        return [sum(int(a) * int(b) for a, b in zip(row, query)) for row in self.vectors[lo:hi]]

    def top(self, query: np.ndarray, k: int, beat: float, ids: np.ndarray, own: int, uids: np.ndarray) -> list[tuple[int, int]]:
        """The k best (score, -id) at least as high as beat, without the query's own row."""
        length = float(np.sqrt((query**2).sum()))
        exact = length * self.longest < _EXACT / 2
        bound = self.centre @ query + self.radius * length
        bound += 1e-9 * length * self.size + 1e-6
        heap, best = [(-bound[0], 0)], []
        while heap:
            top, node = heapq.heappop(heap)
            level = max(beat, best[0][0] if len(best) == k else -np.inf)
            if -top < level:
                break
            if self.child[node]:
                for c in self.child[node]:
                    if bound[c] >= level:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            lo, hi = self.span[node]
            for at, s in enumerate(self.scores(lo, hi, query, exact), lo):
                if s < beat:
                    continue
                item = (s, -int(ids[at]))
                if uids[at] != own and (len(best) < k or item > best[0]):
                    (heapq.heappush if len(best) < k else heapq.heapreplace)(best, item)
        return sorted(best, reverse=True)


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column.to_pylist()])


def in_shard(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """qid, query, beat against uid, vec_id, v of one shard -> qid, vec_id, score."""
    out: tuple[list, list, list] = ([], [], [])
    if queries.num_rows and vectors.num_rows:
        tree = BallTree(_matrix(vectors.column("v")))
        ids, uids = (np.asarray(vectors.column(c))[tree.order] for c in ("vec_id", "uid"))
        for qid, q, beat in zip(queries.column("qid").to_pylist(), queries.column("query").to_pylist(), queries.column("beat").to_pylist()):
            for s, i in tree.top(np.frombuffer(q, np.float64), k, -np.inf if beat is None else beat, ids, qid, uids):
                for column, value in zip(out, (qid, -i, max(-_LONG - 1, min(_LONG, s)))):
                    column.append(value)
    return pa.table({"qid": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})


def _sharded(rows: DataFrame, n: int) -> DataFrame:
    """rows with cell and shard."""
    own: dict[int, np.ndarray] = {}
    for dim in [r.dim for r in rows.select("dim").distinct().collect()]:  # lengths of vectors
        fitted = np.stack([np.frombuffer(r.v, np.float64) for r in rows.filter(F.col("dim") == dim).orderBy(F.xxhash64("uid"), "uid").select("v").limit(SAMPLE).collect()])
        own[dim] = centres(fitted, max(1, min(MOST_CELLS, -(-n // SHARD))))
    shared = rows.sparkSession.sparkContext.broadcast(own)

    def cell(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            out = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                out[at] = dim * MOST_CELLS + nearest(_matrix(batch.column("v").take(pa.array(at))), shared.value[dim], 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "cell"])

    celled = rows.mapInArrow(cell, "uid long, vec_id long, dim long, v binary, cell long")
    counted = {r.cell: r.n for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_CELLS a length
    most = max(1, MOST_SHARDS // max(1, len(counted)))
    parts = {c: max(1, min(most, -(-x // SHARD))) for c, x in counted.items()}
    split = F.create_map(*[F.lit(x) for c, p in parts.items() for x in (c, p)]) if parts else F.create_map(F.lit(0), F.lit(1))
    shard = F.col("cell") * MOST_SHARDS + F.pmod(F.xxhash64("uid"), F.element_at(split, F.col("cell")).cast("long"))
    return celled.withColumn("shard", shard)


def balls(t: pa.Table) -> pa.Table:
    v = _matrix(t.column("v"))
    mid = v.mean(axis=0)
    radius = float(np.sqrt(((v - mid) ** 2).sum(axis=1).max()))
    return pa.table({"shard": t.column("shard")[:1], "dim": t.column("dim")[:1], "centre": pa.array([mid.tobytes()], pa.binary()), "radius": pa.array([radius])})


def top_k(rows: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by every, over all other rows (vec_id, embedding).

    A component x counts as floor(scale * x) in double precision. Vectors that are null or empty or hold null or non-finite
    components take no part, nor do rows with a null vec_id; vectors of different lengths aren't compared. Of rows with one
    vec_id each is a query and a candidate of its own, so ranks of one query_id then repeat. Ties go to the smaller vec_id.
    Scores beyond a long are cut to its range; vectors with a component that scale makes infinite take no part. Other columns are
    ignored; an empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession)
    rows = with_uid(rows, scratch, "embedding", key="vec_id").filter("vec_id is not null").filter(finite("embedding"))

    def whole(batches):
        for batch in batches:
            with np.errstate(over="ignore"):
                v = [np.floor(scale * np.array(x, np.float64)) for x in batch.column("v").to_pylist()]
            good = [i for i, x in enumerate(v) if np.isfinite(x).all()]
            batch, v = batch.take(pa.array(good, pa.int64())), [v[i] for i in good]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("vec_id"), pa.array([len(x) for x in v], pa.int64()), pa.array([x.tobytes() for x in v], pa.binary())], ["uid", "vec_id", "dim", "v"])

    vectors = rows.select("uid", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).mapInArrow(whole, "uid long, vec_id long, dim long, v binary")
    vectors = scratch.keep(vectors)
    n = vectors.count()
    sharded = scratch.keep(_sharded(vectors, n)) if n else vectors.withColumn("shard", F.lit(0).cast("long"))
    shards = sharded.groupBy("shard").applyInArrow(balls, "shard long, dim long, centre binary, radius double").collect()  # at most MOST_SHARDS
    shared = rows.sparkSession.sparkContext.broadcast([(r.shard, r.dim, np.frombuffer(r.centre, np.float64), r.radius) for r in shards])
    queries = vectors.filter(F.col("vec_id") % every == 0).select(F.col("uid").alias("qid"), F.col("vec_id").alias("query_id"), "dim", F.col("v").alias("query"))

    def bounds(query: np.ndarray) -> tuple[list, np.ndarray]:
        own = [s for s in shared.value if s[1] == len(query)]
        length = np.sqrt((query**2).sum())
        centre, radius = np.stack([s[2] for s in own]), np.array([s[3] for s in own])
        return own, centre @ query + radius * length + 1e-9 * length * (np.sqrt((centre**2).sum(axis=1)) + radius) + 1e-6

    def route(lo: int, hi: int | None):
        def run(batches):
            for batch in batches:
                at, shard = [], []
                for i, (query, beat) in enumerate(zip(batch.column("query").to_pylist(), batch.column("beat").to_pylist())):
                    own, high = bounds(np.frombuffer(query, np.float64))
                    next_ones = np.argsort(-high, kind="stable")[lo:hi]
                    for j in (next_ones if beat is None else next_ones[high[next_ones] >= beat]).tolist():
                        at.append(i)
                        shard.append(own[j][0])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in ("qid", "query", "beat")), pa.array(shard, pa.int64())], ["qid", "query", "beat", "shard"])

        return run

    def searched(routed: DataFrame) -> DataFrame:
        many = {r.shard: -(-r.k // BLOCK) for r in routed.groupBy("shard").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > BLOCK).collect()}  # at most MOST_SHARDS
        blocks = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("shard")), F.lit(1)).cast("long") if many else F.lit(1).cast("long")
        routed = routed.withColumn("block", F.pmod(F.xxhash64("qid"), blocks))
        dealt = sharded.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        return routed.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(lambda q, v: in_shard(q, v, k), "qid long, vec_id long, score long")

    best, before = None, 0
    for upto in ROUNDS:
        asked = queries.select("qid", "query", F.lit(None).cast("long").alias("beat"))
        if best is not None:
            kth = best.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("beat")).select("qid", F.when(F.col("n") >= k, F.col("beat")).alias("beat"))
            asked = queries.join(kth, "qid", "left").select("qid", "query", "beat")
        found = searched(scratch.keep(asked.mapInArrow(route(before, upto), "qid long, query binary, beat long, shard long")))
        found = found if best is None else best.union(found)
        best = scratch.keep(_first(found, k).drop("rank"))
        if upto is None or len(shards) <= upto:
            break
        before = upto
    out = _first(best, k)
    return out.join(queries.select("qid", "query_id"), "qid").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query (qid, vec_id, score), with rank."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def op8_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
