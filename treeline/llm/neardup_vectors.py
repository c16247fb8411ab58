"""Near-duplicate vectors by a robust-pruned flat graph that is built on overlapping cluster shards.

Equal vectors become one with a count. Each vector goes to its few nearest cells (two levels of cells where there are many
vectors), so a pair that is close shares a shard. In a shard, candidates for a vector's neighbours come from a few random
projection trees, and are pruned robustly (a neighbour is dropped if one kept before is much nearer to it than the vector is);
parts of the shard without a connection are bridged to its medoid. The shards' adjacency lists are united by vertex into one
graph. The search for a vector starts from the medoid and from the vector's own vertex, goes greedily with a beam, and then
expands over all vertices within a widened range until none is left; vectors whose range takes in much of the shard are
compared with the rest of it too. Pairs found are verified in double precision. A pair that shares several shards counts in
the first of them, both for the numbers of links and for the spanning forests, which are joined into components; pairs
themselves never leave a task.

A shard that stays large, as around one vector that a third of all rows are near, is not searched but compared in full, in
blocks that meet two by two in tasks of their own.

Recall is audited: links of a sample of vectors are counted by brute force, and where too few were found, the search is done
again with more overlap, and in the end by comparing all vectors with each other.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import centres, finite, nearest
from .common import Scratch, components, table, with_uid

log = logging.getLogger(__name__)

SIMILAR = 0.9
#: Vectors in a shard, about; one with more than LARGEST is compared in blocks.
SHARD, LARGEST, BLOCK = 1536, 4096, 4096
#: Cells of one level at most, and vectors that they are fitted on, for each cell and at most.
CELLS, FITTED, MOST_FITTED = 256, 16, 1 << 16
OVERLAP, MOST_OVERLAP = 4, 32
TREES, LEAF, POOL, DEGREE, ALPHA = 6, 64, 48, 24, 1.2
BEAM, WIDER, QUERIES = 12, 0.15, 256
#: Pairs that are looked at together.
PIECE = 1 << 18
#: Vectors of the first audit; it grows until so many of its vectors have links, or to the most.
AUDIT, WITH_LINKS, MOST_AUDIT, RECALL = 512, 64, 1 << 15, 0.97


# --- the graph of one shard ------------------------------------------------------------------------------------------------


def leaves(units: np.ndarray, seed: int) -> np.ndarray:
    """The leaf of each vector in a tree of random projections, each node parted in equal halves."""
    m = len(units)
    node, rng = np.zeros(m, np.int64), np.random.default_rng(seed)
    for _ in range(max(0, int(np.ceil(np.log2(m / LEAF))))):
        count = int(node.max()) + 1
        ends = units[np.argsort(rng.random(m))[:m]]
        one = np.zeros((count, units.shape[1]), units.dtype)
        other = one.copy()
        order = rng.permutation(m)
        one[node[order]], other[node[order[::-1]]] = ends[order], ends[order[::-1]]
        way = one - other + 1e-3 * rng.normal(size=one.shape).astype(units.dtype)
        by = np.lexsort(((units * way[node]).sum(axis=1), node))
        starts = np.searchsorted(node[by], np.arange(count))
        sizes = np.diff(np.append(starts, m))
        upper = np.arange(m) - starts[node[by]] >= (sizes[node[by]] + 1) // 2
        node[by] = 2 * node[by] + upper
        node = np.unique(node, return_inverse=True)[1]
    return node


def pools(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest few of each vector's companions in the leaves of all trees: numbers (-1: none) and similarities."""
    m = len(units)
    ids, sims = np.full((m, 0), -1, np.int64), np.zeros((m, 0), units.dtype)
    for t in range(TREES if m > LEAF else 1):
        node = leaves(units, t)
        by = np.argsort(node, kind="stable")
        starts = np.flatnonzero(np.diff(node[by], prepend=-1))
        sizes = np.diff(np.append(starts, m))
        wide = int(sizes.max())
        at = starts[:, None] + np.arange(wide)
        there = np.arange(wide) < sizes[:, None]
        own = by[np.minimum(at, m - 1)]
        for lo in range(0, len(own), 64):
            v = units[own[lo : lo + 64]]
            near = v @ v.transpose(0, 2, 1)
            near[~np.repeat(there[lo : lo + 64, None, :], wide, axis=1)] = -np.inf
            near[:, np.arange(wide), np.arange(wide)] = -np.inf
            k = min(POOL, wide)
            best = np.argpartition(-near, k - 1, axis=2)[:, :, :k]
            here = there[lo : lo + 64]
            if lo == 0:
                new_ids, new_sims = np.full((m, k), -1, np.int64), np.full((m, k), -np.inf, units.dtype)
            rows = own[lo : lo + 64][here]
            new_ids[rows] = np.take_along_axis(np.repeat(own[lo : lo + 64, None, :], wide, axis=1), best, axis=2)[here]
            new_sims[rows] = np.take_along_axis(near, best, axis=2)[here]
        new_ids[np.isneginf(new_sims)] = -1
        ids, sims = np.concatenate([ids, new_ids], axis=1), np.concatenate([sims, new_sims], axis=1)
        order = np.argsort(ids, axis=1, kind="stable")  # of a companion in several trees one stays
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        again = np.zeros(ids.shape, bool)
        again[:, 1:] = ids[:, 1:] == ids[:, :-1]
        ids[again], sims[again] = -1, -np.inf
        order = np.argsort(-sims, axis=1, kind="stable")[:, :POOL]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
    return ids, sims


def pruned_edges(units: np.ndarray) -> np.ndarray:
    """Edges (i, j), both ways: robust pruning of each vector's pool to DEGREE, and bridges from the medoid to parts apart."""
    m = len(units)
    if m < 2:
        return np.zeros((0, 2), np.int64)
    ids, sims = pools(units)
    edges = []
    for lo in range(0, m, 512):
        own, near = ids[lo : lo + 512], sims[lo : lo + 512]
        v = units[np.maximum(own, 0)]
        between = v @ v.transpose(0, 2, 1)
        apart, alive, rows = np.maximum(1 - near, 0), own >= 0, np.arange(len(own))
        for _ in range(min(DEGREE, own.shape[1])):
            first = np.argmax(alive, axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            edges.append(np.stack([rows[some] + lo, own[rows[some], first[some]]], axis=1))
            alive &= ALPHA * np.maximum(1 - between[rows, first], 0) > apart
            alive[rows, first] = False
    found = np.concatenate(edges)
    label = forest(np.arange(m), np.sort(found, axis=1))
    parts = np.unique(label)
    if len(parts) > 1:  # each part's vector nearest to the shard's centre becomes the medoid's neighbour
        to = units @ units.mean(axis=0)
        order = np.lexsort((-to, label))
        heads = order[np.searchsorted(label[order], parts)]
        medoid = int(np.argmax(to))
        found = np.concatenate([found, np.stack([np.full(len(heads), medoid), heads], axis=1)[heads != medoid]])
    found = np.concatenate([found, found[:, ::-1]])
    return np.unique(found, axis=0)


def shard_edges(rows: pa.Table) -> pa.Table:
    """uid, unit of one shard -> uid, neighbours."""
    uid = np.asarray(rows.column("uid"))
    order = np.argsort(uid, kind="stable")
    uid = uid[order]
    edges = pruned_edges(_unit_rows(rows)[order].astype(np.float32))
    starts = np.searchsorted(edges[:, 0], np.arange(len(uid) + 1))
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(uid[edges[:, 1]], pa.int64()))
    return pa.table({"uid": pa.array(uid), "neighbours": lists})


# --- the search --------------------------------------------------------------------------------------------------------------


def _next_to(starts: np.ndarray, flat: np.ndarray, q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, neighbour) for pairs (query, vertex)."""
    count = starts[node + 1] - starts[node]
    ends = np.cumsum(count)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[node] - (ends - count), count)
    return np.repeat(q, count), flat[at]


def searched(units: np.ndarray, starts: np.ndarray, flat: np.ndarray, level: float) -> Iterator[np.ndarray]:
    """Pairs (i < j) within the widened range that the search finds, in pieces; flat[starts[i] : starts[i + 1]] is next to i."""
    m = len(units)
    if m < 2:
        return
    small = units.astype(np.float32)
    medoid = int(np.argmax(small @ small.mean(axis=0)))
    wide = np.float32(level - WIDER)
    for lo in range(0, m, QUERIES):
        n = min(QUERIES, m - lo)
        rows = np.arange(n)
        seen, spread = np.zeros((n, m), bool), np.zeros((n, m), bool)
        ranged: list[np.ndarray] = []

        def look(q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Those pairs not seen before, with similarities; those in the widened range are remembered."""
            new = ~seen[q, node]
            key = np.unique(q[new] * m + node[new])
            q, node = key // m, key % m
            seen[q, node] = True
            near = np.concatenate([np.zeros(0, np.float32), *(np.einsum("ij,ij->i", small[lo + q[i : i + PIECE]], small[node[i : i + PIECE]]) for i in range(0, len(q), PIECE))])
            ranged.append(np.stack([q, node])[:, near >= wide])
            return q, node, near

        ids, sims, done = np.full((n, BEAM), -1, np.int64), np.full((n, BEAM), -np.inf, np.float32), np.ones((n, BEAM), bool)

        def hold(q: np.ndarray, node: np.ndarray, near: np.ndarray) -> None:
            """Keeps each query's best few."""
            nonlocal ids, sims, done
            place = np.arange(len(q)) - np.searchsorted(q, q)
            more = int(place.max()) + 1 if len(q) else 0
            new_ids, new_sims = np.full((n, more), -1, np.int64), np.full((n, more), -np.inf, np.float32)
            new_ids[q, place], new_sims[q, place] = node, near
            all_ids, all_sims, all_done = np.concatenate([ids, new_ids], axis=1), np.concatenate([sims, new_sims], axis=1), np.concatenate([done, new_ids < 0], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :BEAM]
            ids, sims, done = (np.take_along_axis(x, order, axis=1) for x in (all_ids, all_sims, all_done))

        hold(*look(np.concatenate([rows, rows]), np.concatenate([np.full(n, medoid), lo + rows])))
        for _ in range(2 * BEAM):
            first = np.argmin(done, axis=1)
            some = np.flatnonzero(~done[rows, first])
            if not len(some):
                break
            done[some, first[some]] = True
            node = ids[some, first[some]]
            spread[some, node] = True
            hold(*look(*_next_to(starts, flat, some, node)))
        checked = 0
        while checked < len(ranged):
            q, node = np.concatenate(ranged[checked:], axis=1)
            checked = len(ranged)
            new = ~spread[q, node]
            q, node = q[new], node[new]
            spread[q, node] = True
            full = np.bincount(np.concatenate([x[0] for x in ranged]), minlength=n) > m // 16
            few = ~full[q]
            whole = np.flatnonzero(full & ~seen.all(axis=1))
            if len(whole):
                near = small[lo + whole] @ small.T
                x, y = np.nonzero((near >= wide) & ~seen[whole])
                ranged.append(np.stack([whole[x], y]))
                seen[whole] = True
            q, node = q[few], node[few]
            for i in range(0, len(q), 1 << 14):
                look(*_next_to(starts, flat, q[i : i + (1 << 14)], node[i : i + (1 << 14)]))
        q, node = np.concatenate(ranged, axis=1)
        yield np.stack([np.minimum(lo + q, node), np.maximum(lo + q, node)], axis=1)[lo + q != node]


def verified(units: np.ndarray, pieces: Iterator[np.ndarray], level: float) -> Iterator[np.ndarray]:
    """Of pairs that either or both ends have found, each once, those at or above the level in double precision; in pieces."""
    m = len(units)
    keys = np.unique(np.concatenate([np.zeros(0, np.int64), *(p[:, 0] * m + p[:, 1] for p in pieces)]))
    for i in range(0, len(keys), PIECE):
        a, b = keys[i : i + PIECE] // m, keys[i : i + PIECE] % m
        yield np.stack([a, b], axis=1)[np.einsum("ij,ij->i", units[a], units[b]) >= level]


def compared(units: np.ndarray, block: np.ndarray, level: float) -> Iterator[np.ndarray]:
    """All pairs (i < j) at or above the level, within one block or between two (block is ascending), in pieces."""
    m = len(units)
    other = int(np.searchsorted(block, block[-1])) if m else 0
    step = max(1, (1 << 21) // max(1, m))
    for lo in range(0, other or m, step):
        hi, first = min(lo + step, other or m), other or lo
        near = units[lo:hi] @ units[first:].T >= level
        found = np.argwhere(near if other else np.triu(near, 1))
        yield found + [lo, first]


def forest(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The least index each vector is joined to by pairs, and by the label it had."""
    pairs = np.concatenate([np.stack([label, np.arange(len(label))], axis=1), pairs])
    while True:
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _unit_rows(batch) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in batch.column("unit").to_pylist()])


def counted(rows: pa.Table, level: float) -> pa.Table:
    """One shard's rows -> (uid, other null, n) numbers of links and (uid, other, 0) forest edges, of pairs whose first common shard
    this is. With a column neighbours the rows are searched, with a column block they are compared."""
    search = "neighbours" in rows.schema.names
    order = np.lexsort((np.asarray(rows.column("uid")), np.zeros(rows.num_rows) if search else np.asarray(rows.column("block"))))
    rows = rows.take(pa.array(order))
    uid, copies, units = np.asarray(rows.column("uid")), np.asarray(rows.column("copies")), _unit_rows(rows)
    m, shards, here = len(uid), rows.column("shards").combine_chunks(), rows.column("shard")[0].as_py()
    sizes = np.diff(np.asarray(shards.offsets))
    own = np.full((m, int(sizes.max())), -1, np.int64)
    own[np.repeat(np.arange(m), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(shards.flatten())
    if search:
        lists = rows.column("neighbours").combine_chunks()
        bounds, flat = np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.flatten())
        at = np.minimum(np.searchsorted(uid, flat), m - 1)
        inside = uid[at] == flat
        starts = np.concatenate([[0], np.cumsum(inside)])[bounds - bounds[0]]
        pieces = verified(units, searched(units, starts, at[inside], level), level)
    else:
        pieces = compared(units, np.asarray(rows.column("block")), level)
    label, count = np.arange(m), np.zeros(m, np.int64)
    for a, b in (p.T for found in pieces for p in np.split(found, range(PIECE, len(found), PIECE))):
        least = np.full(len(a), np.iinfo(np.int64).max)
        for x in range(own.shape[1]):
            both = (own[a, x][:, None] == own[b]).any(axis=1) & (own[a, x] >= 0)
            least = np.minimum(least, np.where(both, own[a, x], least))
        a, b = a[least == here], b[least == here]
        label = forest(label, np.stack([a, b], axis=1))
        count += np.bincount(a, weights=copies[b], minlength=m).astype(np.int64) + np.bincount(b, weights=copies[a], minlength=m).astype(np.int64)
    some, joined = np.flatnonzero(count), np.flatnonzero(label != np.arange(m))
    return pa.table({
        "uid": pa.array(np.concatenate([uid[some], uid[joined]])), "other": pa.array([None] * len(some) + uid[label[joined]].tolist(), pa.int64()),
        "n": pa.array(np.concatenate([count[some], np.zeros(len(joined), np.int64)])),
    })


# --- all shards --------------------------------------------------------------------------------------------------------------


def placed(reps: DataFrame, n: int, overlap: int) -> DataFrame:
    """uid, unit, copies, shard, shards: a row for each shard of each vector."""
    first: dict[int, np.ndarray] = {}
    second: dict[int, list[np.ndarray]] = {}
    cells = max(1, -(-n * overlap // SHARD))
    for dim in [r.dim for r in reps.select("dim").distinct().collect()]:  # lengths of vectors
        chosen = reps.filter(F.col("dim") == dim).orderBy(F.xxhash64("uid"), "uid").select("unit").limit(min(MOST_FITTED, max(4096, FITTED * cells)))
        fitted = np.stack([np.frombuffer(r.unit, np.float64) for r in chosen.collect()])
        outer = cells if cells <= CELLS else max(2, min(CELLS, int(np.ceil(np.sqrt(cells)))))
        first[dim] = centres(fitted, outer)
        if cells > CELLS:
            near = nearest(fitted, first[dim], 1)[:, 0]
            second[dim] = [centres(fitted[near == c], min(CELLS, -(-cells // outer))) if (near == c).any() else first[dim][c : c + 1] for c in range(len(first[dim]))]
    shared = reps.sparkSession.sparkContext.broadcast((first, second))  # at most CELLS * (CELLS + 1) centres of each length

    def run(batches):
        first, second = shared.value
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            shard, source, lists = [], [], []
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                units = _unit_rows(batch.take(pa.array(at)))
                cells = nearest(units, first[dim], overlap)
                for i, u, own in zip(at.tolist(), units, cells.tolist()):
                    if dim in second:  # the nearest of all inner cells of these cells
                        inner = [(c, x) for c in own for x in range(len(second[dim][c]))]
                        chosen = nearest(u[None], np.concatenate([second[dim][c] for c in own]), overlap)[0].tolist()
                        pairs = [inner[k] for k in chosen]
                    else:
                        pairs = [(c, 0) for c in own]
                    names = sorted((dim * CELLS + c) * CELLS + x for c, x in pairs)
                    shard.extend(names)
                    source.extend([i] * len(names))
                    lists.extend([names] * len(names))
            out = batch.take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([out.column("uid"), out.column("unit"), out.column("copies"), pa.array(shard, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["uid", "unit", "copies", "shard", "shards"])

    return reps.select("uid", "dim", "unit", "copies").mapInArrow(run, "uid long, unit binary, copies long, shard long, shards array<long>")


def blocked(rows: DataFrame, blocks) -> DataFrame:
    """uid, unit, copies, shard, shards, of shards with so many blocks (a column): block, and a row for each two blocks (least, most)
    that meet; rows of one block meet each other only where least = most."""
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select("uid", "unit", "copies", "shard", "shards", "block", F.least("block", "other").alias("least"), F.greatest("block", "other").alias("most"))


FOUND = "uid long, other long, n long"


def _compared(rows: DataFrame, level: float) -> DataFrame:
    return rows.groupBy("shard", "least", "most").applyInArrow(lambda t: counted(t, level), FOUND)


def links(reps: DataFrame, n: int, overlap: int, level: float, scratch: Scratch) -> DataFrame:
    """uid, other, n: numbers of links and forest edges of all shards."""
    rows = scratch.keep(placed(reps, n, overlap))
    large = [(r.shard, r.k) for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > LARGEST).collect()]  # of CELLS * CELLS at most
    blocks = F.element_at(F.create_map(*[F.lit(x) for s, k in large for x in (s, -(-k // BLOCK))]), F.col("shard")).cast("long") if large else None
    small = rows.filter(~F.col("shard").isin([s for s, _ in large])) if large else rows
    graph = small.groupBy("shard").applyInArrow(shard_edges, "uid long, neighbours array<long>")
    graph = scratch.keep(graph.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")))
    found = small.join(graph, "uid").groupBy("shard").applyInArrow(lambda t: counted(t, level), FOUND)
    if large:
        found = found.union(_compared(blocked(rows.filter(F.col("shard").isin([s for s, _ in large])), blocks), level))
    return scratch.keep(found)


def exact_links(reps: DataFrame, n: int, level: float, scratch: Scratch) -> DataFrame:
    """The same by comparing all vectors of one length."""
    rows = reps.select("uid", "unit", "copies", F.col("dim").alias("shard"), F.array("dim").alias("shards"))
    return scratch.keep(_compared(blocked(rows, F.lit(-(-n // BLOCK)).cast("long")), level))


def audited(reps: DataFrame, most: int, level: float) -> DataFrame:
    """uid, real (links by brute force, copies counted) of a sample of vectors of bounded size."""
    chosen = reps.orderBy(F.xxhash64("uid", F.lit(1)), "uid").select("uid", "dim", "unit").limit(most).collect()
    shared = reps.sparkSession.sparkContext.broadcast([(r.uid, r.dim, bytes(r.unit)) for r in chosen])

    def run(batches):
        queries = shared.value
        uid = np.array([q[0] for q in queries], np.int64)
        total = np.zeros(len(queries))
        by_dim = {d: np.array([i for i, q in enumerate(queries) if q[1] == d]) for d in {q[1] for q in queries}}
        units = {d: np.stack([np.frombuffer(queries[i][2], np.float64) for i in at]) for d, at in by_dim.items()}
        for batch in batches:
            dims, own, copies = (np.asarray(batch.column(c)) for c in ("dim", "uid", "copies"))
            for d, at in by_dim.items():
                rows = np.flatnonzero(dims == d)
                if len(rows):
                    close = units[d] @ _unit_rows(batch.take(pa.array(rows))).T >= level
                    close &= uid[at][:, None] != own[rows][None]
                    total[at] += close @ copies[rows].astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(total)], ["uid", "real"])

    return reps.select("uid", "dim", "unit", "copies").mapInArrow(run, "uid long, real double").groupBy("uid").agg(F.sum("real").alias("real"))


def audit(reps: DataFrame, n: int, level: float, scratch: Scratch) -> DataFrame:
    """A sample that has enough vectors with links, or is the largest, or all."""
    most = AUDIT
    while True:
        truth = scratch.keep(audited(reps, most, level))
        if most >= min(n, MOST_AUDIT) or truth.filter("real > 0").count() >= WITH_LINKS:
            return truth
        most *= 8


def recall(truth: DataFrame, found: DataFrame) -> tuple[float, int]:
    """The lesser of the share of all true links that were found and the mean share of each vector that has some; and how many
    vectors have some."""
    counts = found.filter("other is null").groupBy("uid").agg(F.sum("n").alias("n"))
    part = F.least(F.coalesce("n", F.lit(0)), "real") / F.col("real")
    row = truth.filter("real > 0").join(counts, "uid", "left").agg(F.count(F.lit(1)), F.avg(part), F.sum(F.col("real") * part) / F.sum("real")).first()
    return (min(row[1], row[2]), row[0]) if row[0] else (1.0, 0)


def all_links(reps: DataFrame, n: int, level: float, scratch: Scratch) -> DataFrame:
    """With as much overlap as the audit asks for; then all vectors with each other."""
    truth, overlap = audit(reps, n, level, scratch), OVERLAP
    while overlap <= MOST_OVERLAP:
        found = links(reps, n, overlap, level, scratch)
        share, of = recall(truth, found)
        log.info("%d cells a vector: recall %.4f, measured on %d vectors with links", overlap, share, of)
        if share >= RECALL:
            return found
        overlap *= 2
    log.warning("recall stays below %.2f: all vectors are compared", RECALL)
    return exact_links(reps, n, level, scratch)


def near_duplicates(rows: DataFrame, level: float = SIMILAR) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row for each row of rows (vec_id, embedding).

    Null, empty or zero vectors and those with null or non-finite components link with nothing; vectors of different lengths
    never link. Repeated vec_ids are vectors of their own; a null vec_id comes last in the order of ids and its component_id
    may be null; kept holds where vec_id equals component_id (false for null). Other columns are ignored. An empty table
    gives no rows.
    """
    scratch = Scratch(rows.sparkSession)
    rows = with_uid(rows, scratch, "embedding", key="vec_id")
    good = rows.filter(finite("embedding")).select("uid", F.transform("embedding", lambda x: x.cast("double")).alias("v"))

    def scale(batches):
        for batch in batches:
            uid, dim, unit = [], [], []
            for u, v in zip(batch.column("uid").to_pylist(), batch.column("v").to_pylist()):
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                if top > 0:
                    x = x / top
                    uid.append(u)
                    dim.append(len(x))
                    unit.append((x / np.sqrt((x * x).sum())).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(dim, pa.int64()), pa.array(unit, pa.binary())], ["uid", "dim", "unit"])

    units = scratch.keep(good.mapInArrow(scale, "uid long, dim long, unit binary"))
    reps = scratch.keep(units.groupBy("dim", "unit").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("copies")))
    n = reps.count()
    if n:
        found = all_links(reps, n, level, scratch)
        counts = found.filter("other is null").groupBy("uid").agg(F.sum("n").alias("n"))
    else:
        found = rows.select("uid", F.lit(None).cast("long").alias("other"), F.lit(0).cast("long").alias("n")).limit(0)
        counts = found.groupBy("uid").agg(F.sum("n").alias("n"))
    joined = components(found.filter("other is not null").select(F.col("uid").alias("a"), F.col("other").alias("b")), scratch)
    by_rep = reps.join(counts, "uid", "left").join(joined.withColumnRenamed("node", "uid"), "uid", "left")
    by_rep = by_rep.select("dim", "unit", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "uid").alias("c"))
    by_row = units.join(by_rep, ["dim", "unit"]).select("uid", "n_links", "c")
    out = rows.select("uid", "vec_id").join(by_row, "uid", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "uid").alias("c"))
    ids = rows.select(F.col("uid").alias("c"), F.col("vec_id").alias("component_id"))
    return out.join(ids, "c").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_near_vectors(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
      WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, list_transform(e, lambda x: x / n) AS e FROM g WHERE n > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.9),
c AS (SELECT vec_id AS v, vec_id AS u FROM v UNION SELECT c.v, p.y FROM c JOIN p ON p.x = c.u),
m AS (SELECT v, min(u) AS component_id FROM c GROUP BY v),
k AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN m ON m.v = vec_id LEFT JOIN k ON k.x = vec_id
"""
