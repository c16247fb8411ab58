"""Exact Jaccard join on word n-grams by grouped prefixes.

Documents with the same set of shingles are one class. Every class's shingles are put in one order, rare ones first; two
sets as similar as asked share a shingle among the first few of each (the prefix). Classes with the same prefix and size
form a group; groups that share a token of their prefixes, with sizes that allow the similarity, are candidates, and members
of candidate groups, or of one group, are verified on whole sets. Tokens that the same groups have (a pair of near
copies shares dozens) are one list.

The order's frequencies are counts in a table of fixed size (several shingles may share a counter), so what is sent to all
tasks has a fixed size; any order is right, this one keeps passages that many documents share out of the prefixes.

A set's sketch has a bit for each of a few hundred counters: whether an odd number of its shingles fall there. Two sketches
differ in at most as many bits as the sets differ in shingles, so a pair whose sketches differ in more than the similarity
allows needs no verification.

What is asked for are classes of linked documents. So pairs are made in rounds: first neighbours in each list and each list's
first entry with the others; then, only for lists that still hold more than one component, neighbours in random orders
that are in different components; last all pairs across components of such lists. No link between components is missed,
and no list of N copies becomes N * N pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, Words, components, grams, lean, mix64, partitions, signed, slices, table, with_uid

#: Counters of the frequency table, and how many travel in one row.
COUNTERS, CHUNK = 1 << 20, 1 << 12
#: Bytes of a shingle's hash that sets are compared by first. Agreement by accident can only make a pair look more similar, so pairs
#: that fail are settled, and those that pass so well that as many accidents are less likely than 2**-64; the others are compared
#: by whole hashes.
KEPT, WHOLE = 5, 8
#: Words of 64 bits in a sketch at least; it has a bit for each shingle at least.
SKETCH = 8
#: Bits, a power of two, of the map of documents whose sets are needed (others with the same bit are computed in vain), and
#: bytes of it in one row; where more documents than MAPPED are needed they are joined instead.
MAP_BITS, MAP_PART, MAPPED = 26, 1 << 13, 1 << 23
#: Entries of a list that are ordered, or compared with others, in one task; a longer list is dealt into parts.
PART = 1024
#: Rows of a list that is held to see whether another token has the same ones.
LONG = 1 << 16
#: Rounds that try random pairs across components before all are tried.
RANDOM_ROUNDS = 1


def shingles(words: Words, i: int, n: int) -> np.ndarray:
    """Distinct hashes of a document's shingles; of all its words if they are fewer than n."""
    h = words.of(i)
    if len(h) >= n:
        return np.unique(grams(h, n))
    return grams(h, len(h)) ^ np.uint64(len(h)) if len(h) else np.zeros(0, np.uint64)


def frequency_classes(docs: DataFrame, n: int) -> np.ndarray:
    """For each counter the base-2 logarithm of its count, as one byte."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in slices(batches):
            words = Words(batch.column("text"), lower=True)
            found = [shingles(words, i, n) for i in range(len(words))]
            total += np.bincount((np.concatenate(found) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        parts = total.astype("<i8").reshape(-1, CHUNK)
        used = np.flatnonzero(parts.any(axis=1))
        small = int(total.max()) < 2**31
        for lo in range(0, len(used), 64):
            some = used[lo : lo + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[i].astype("<i4" if small else "<i8").tobytes() for i in some], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = -1, None

        def done() -> pa.RecordBatch:
            classes = np.floor(np.log2(np.maximum(total, 1))).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([classes.tobytes()], pa.binary())], ["part", "classes"])

        for batch in batches:
            for p, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                if p != part:
                    if total is not None:
                        yield done()
                    part, total = p, np.zeros(CHUNK, np.int64)
                total += np.frombuffer(counts, "<i4" if len(counts) == 4 * CHUNK else "<i8")
        if total is not None:
            yield done()

    counts = docs.select("text").mapInArrow(lean(count), "part int, counts binary")
    counts = counts.repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part")
    classes = np.zeros(COUNTERS, np.uint8)
    for row in counts.mapInArrow(add, "part int, classes binary").collect():  # one byte for each counter
        classes[row.part * CHUNK : (row.part + 1) * CHUNK] = np.frombuffer(row.classes, np.uint8)
    return classes


def prefixes(docs: DataFrame, n: int, percent: int, classes: np.ndarray) -> DataFrame:
    """uid, doc_id, n (size), set1, set2 (hashes of the whole set), sketch, prefix (hashes, in order)."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        for batch in slices(batches):
            words = Words(batch.column("text"), lower=True)
            size, one, two, prefix, sketch = [], [], [], [], []
            for i in range(len(words)):
                s = shingles(words, i, n)
                size.append(len(s))
                mixed = mix64(s)
                one.append(int(mixed.sum(dtype=np.uint64)))
                two.append(int(mix64(mixed + np.uint64(7)).sum(dtype=np.uint64)))
                bits = max(64 * SKETCH, 1 << max(len(s) - 1, 0).bit_length())
                odd = np.bincount((mixed % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
                sketch.append(np.packbits(odd.astype(np.uint8)).view(np.int64).tolist())
                k = len(s) - (percent * len(s) + 99) // 100 + 1 if len(s) else 0
                prefix.append(s[np.argsort(classes[(s % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")[:k]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("doc_id"), pa.array(size, pa.int64()), signed(np.array(one, np.uint64)), signed(np.array(two, np.uint64)), pa.array(sketch, pa.list_(pa.int64())), pa.array(prefix, pa.binary())],
                ["uid", "doc_id", "n", "set1", "set2", "sketch", "prefix"],
            )

    return docs.select("uid", "doc_id", "text").mapInArrow(lean(run), "uid long, doc_id long, n long, set1 long, set2 long, sketch array<long>, prefix binary")


def postings(leaders: DataFrame) -> DataFrame:
    """uid, prefix -> token, uid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.asarray(pa.compute.binary_length(batch.column("prefix")), np.int64) // 8
            tokens = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), np.int64)
            uid = np.repeat(np.asarray(batch.column("uid")), lengths)
            for lo in range(0, len(tokens), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(tokens[part]), pa.array(uid[part])], ["token", "uid"])

    return leaders.select("uid", "prefix").mapInArrow(lean(run), "token long, uid long")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of token, those whose token comes more than once, as key, uid: the key is a hash of all the token's
    uids, so that tokens with the same ones give the same list. A list of more than LONG rows has a key of its own and passes
    through; no more than that is held."""

    def rows(key: np.ndarray, uid: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([signed(key), pa.array(uid)], ["key", "uid"])

    token, uid, long = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in _and_end(batches):
        if batch is not None:
            if not batch.num_rows:
                continue
            token = np.concatenate([token, np.asarray(batch.column("token"))])
            uid = np.concatenate([uid, np.asarray(batch.column("uid"))])
        if long is not None and len(token):  # the rest of a long list
            n = int(np.searchsorted(token, long[0], "right"))
            if n:
                yield rows(np.repeat(_own_key(long), n), uid[:n])
            long = long if n == len(token) else None
            token, uid = token[n:], uid[n:]
        if not len(token):
            continue
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        end = len(token) if batch is None else int(starts[-1])
        if end:
            starts = starts[starts < end]
            counts = np.diff(np.append(starts, end))
            sums = np.add.reduceat(mix64(uid[:end].view(np.uint64) + np.uint64(1)), starts)
            key = np.where(counts > LONG, _own_key(token[starts]), mix64(sums ^ counts.astype(np.uint64)))
            keep = np.repeat(counts > 1, counts)
            if keep.any():
                yield rows(np.repeat(key, counts)[keep], uid[:end][keep])
        token, uid = token[end:], uid[end:]
        if len(token) > LONG:
            long = token[:1]
            yield rows(np.repeat(_own_key(long), len(token)), uid)
            token, uid = token[:0], uid[:0]


def _own_key(token: np.ndarray) -> np.ndarray:
    return mix64(token.view(np.uint64) + np.uint64(3))


def _and_end(batches):
    yield from batches
    yield None


def _bit(uid: np.ndarray) -> np.ndarray:
    return (mix64(uid.view(np.uint64)) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def bit_map(uids: DataFrame) -> np.ndarray:
    """A map of fixed size with the bits of all uids set."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
        for batch in batches:
            at = _bit(np.asarray(batch.column(0), np.int64))
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        parts = bits.reshape(-1, MAP_PART)
        used = np.flatnonzero(parts.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["part", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = None, None
        for batch in batches:
            for p, raw in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist()):
                if p != part:
                    if own is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "bits"])
                    part, own = p, np.zeros(MAP_PART, np.uint8)
                own |= np.frombuffer(raw, np.uint8)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "bits"])

    schema = "part int, bits binary"
    rows = uids.mapInArrow(mark, schema).repartition(partitions(uids.sparkSession), "part").sortWithinPartitions("part").mapInArrow(unite, schema)
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in rows.collect():  # 2**(MAP_BITS - 3) bytes in all
        out[r.part * MAP_PART : (r.part + 1) * MAP_PART] = np.frombuffer(r.bits, np.uint8)
    return out


def sets(docs: DataFrame, n: int, uids: DataFrame, kept: int) -> DataFrame:
    """uid, members (so many leading bytes of the hashes of shingles, ascending) of these documents and perhaps some others; texts stay where they are
    read, by a bit map of the documents, unless there are too many for it."""
    uids = uids.toDF("uid").distinct()
    if uids.count() > MAPPED:
        docs, wanted = docs.join(uids, "uid", "left_semi"), np.full(1 << (MAP_BITS - 3), 255, np.uint8)
    else:
        wanted = bit_map(uids)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = _bit(np.asarray(batch.column("uid"), np.int64))
            batch = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            if not batch.num_rows:
                continue
            words = Words(batch.column("text"), lower=True)
            out = [np.ascontiguousarray(shingles(words, i, n).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :kept]).tobytes() for i in range(len(words))]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(out, pa.binary())], ["uid", "members"])

    return docs.select("uid", "text").mapInArrow(lean(run), "uid long, members binary")


def _unpacked(raw: bytes, kept: int) -> np.ndarray:
    wide = np.zeros((len(raw) // kept, 8), np.uint8)
    wide[:, 8 - kept :] = np.frombuffer(raw, np.uint8).reshape(-1, kept)
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def accidents(x: int, y: int, kept: int) -> int:
    """As many shingles of two sets of these sizes, or fewer, agree by accident, but for a chance below 2**-64."""
    expected, most = x * y / 2.0 ** (8 * kept), 0
    while (math.e * expected / (most + 1)) ** (most + 1) * (1 if most + 1 > expected else 2.0**64) >= 2.0**-64:
        most += 1
    return most


def similar(batches: Iterator[pa.RecordBatch], percent: int, kept: int) -> Iterator[pa.RecordBatch]:
    """a, b, and their sets (rows of one a follow one another) -> the pairs that are similar by so many bytes, and whether that is
    sure."""
    last, left = None, np.zeros(0, np.uint64)
    for batch in batches:
        yes, sure = [], []
        for a, x, y in zip(batch.column("a").to_pylist(), batch.column("set_a"), batch.column("set_b")):
            if a != last:
                last, left = a, _unpacked(x.as_py(), kept)
            right = _unpacked(y.as_py(), kept)
            both = 0
            if len(left) and len(right):
                short, long = (left, right) if len(left) < len(right) else (right, left)
                at = np.searchsorted(long, short)
                both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
            both_of = len(left) + len(right)
            yes.append(100 * both >= percent * (both_of - both))
            both -= accidents(len(left), len(right), kept) if yes[-1] and kept < WHOLE else 0
            sure.append(100 * both >= percent * (both_of - both))
        keep = pa.array(yes, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(sure, pa.bool_()).filter(keep)], ["a", "b", "sure"])


def _similar_pairs(pairs: DataFrame, docs: DataFrame, n: int, percent: int, kept: int) -> DataFrame:
    left, right = (sets(docs, n, pairs.select(side), kept).select(F.col("uid").alias(side), F.col("members").alias(f"set_{side}")) for side in "ab")
    # the merge puts rows of one a together, and a shuffle between the two Python steps: a task has one worker
    rows = pairs.join(right, "b").join(left.hint("merge"), "a")
    return rows.select("a", "set_a", "b", "set_b").mapInArrow(lean(lambda batches: similar(batches, percent, kept)), "a long, b long, sure boolean")


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """Of pairs (a, b), those whose sets are similar. Only documents in pairs become sets."""
    found = scratch.keep(_similar_pairs(pairs, docs, n, percent, KEPT))
    near = found.filter("not sure").select("a", "b")
    if near.isEmpty():
        return found.select("a", "b")
    return found.filter("sure").select("a", "b").union(scratch.keep(_similar_pairs(near, docs, n, percent, WHOLE)).select("a", "b"))


def _sizes_fit(a: str, b: str, percent: int):
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _sketches_fit(x: str, y: str, percent: int):
    """x and y have sketch and n: sets that are similar differ in at most this many shingles, and so in as many bits."""
    a, b = F.col(f"{x}.sketch"), F.col(f"{y}.sketch")
    words = F.least(F.size(a), F.size(b))

    def folded(c):  # parts of the smaller sketch's size add up to that of fewer counters
        parts = F.transform(F.sequence(F.lit(0), (F.size(c) / words).cast("int") - 1), lambda i: F.slice(c, (i * words + 1).cast("int"), words))
        return F.when(F.size(c) > words, F.aggregate(F.slice(parts, 2, 1 << 20), F.element_at(parts, 1), lambda p, q: F.zip_with(p, q, lambda x, y: x.bitwiseXOR(y)))).otherwise(c)

    bits = F.aggregate(F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
    return bits * (100 + percent) <= (100 - percent) * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def parted(lists: DataFrame) -> DataFrame:
    """Lists (key, uid, ...) with parts, a number for each list such that a part has PART entries, about, and part, the row's own."""
    long = lists.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > PART).select("key", F.ceil(F.col("k") / PART).alias("parts"))
    lists = lists.join(long, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    return lists.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(3)), F.col("parts")))


def near_lists(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of neighbours in each list (key, uid, n), or each of its parts, ordered by size, and of its first entry with the others."""
    order = Window.partitionBy("key", "part").orderBy("n", "uid")
    every = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y = F.struct("uid", "n")
    lists = parted(lists)
    firsts = lists.filter("part > 0 or parts > 1").groupBy("key", "part", "parts").agg(F.min(F.struct("n", "uid")).alias("m"))
    firsts = firsts.select("key", F.lit(-1).cast("long").alias("part"), "parts", "m.uid", "m.n")  # parts meet in their first entries
    lists = lists.select("key", "part", "parts", "uid", "n").union(firsts)
    rows = lists.select(y.alias("y"), F.lag(y).over(order).alias("p"), F.first(y).over(every).alias("f"))
    rows = rows.select("y", F.explode(F.array_distinct(F.array("p", "f"))).alias("x")).filter("x is not null and x.uid <> y.uid")
    return _pairs(rows.filter(_sizes_fit("x.n", "y.n", percent)))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b")).distinct()


def likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches (uid, n, sketch) allow the similarity."""
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("uid").alias(side), F.struct("n", "sketch").alias(f"x{side}")), side)
    return pairs.filter(_sketches_fit("xa", "xb", percent)).select("a", "b")


def open_lists(lists: DataFrame) -> DataFrame:
    """Lists (key, uid, c) that hold more than one component."""
    return lists.join(lists.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key"), "key", "left_semi")


def random_neighbours(lists: DataFrame, seed: int, percent: int) -> DataFrame:
    """Pairs of neighbours in a random order of each list (key, uid, n, c), or each of its parts, that are in different components."""
    y = F.struct("uid", "n", "c")
    rows = parted(lists).select(y.alias("y"), F.lag(y).over(Window.partitionBy("key", "part").orderBy(F.xxhash64("uid", "key", F.lit(seed)), "uid")).alias("x"))
    return _pairs(rows.filter("x.c <> y.c").filter(_sizes_fit("x.n", "y.n", percent)))


def across(lists: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """All pairs of entries (key, uid, n, c) of one list, in different components c, whose sizes and sketches (uid, sketch) allow
    the similarity. Any two parts of a list meet in a block of their own; the lists are shuffled to blocks once, for both sides."""
    rows = parted(lists).join(sketches.select("uid", "sketch"), "uid")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "uid", "n", "c", "sketch")
    x, y = rows.alias("x"), rows.alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
    fits = (F.col("x.c") != F.col("y.c")) & (F.col("x.uid") < F.col("y.uid")) & ((F.col("x.lo") == F.col("x.hi")) | (F.col("x.part") != F.col("y.part")))
    fits = fits & _sizes_fit("x.n", "y.n", percent) & _sketches_fit("x", "y", percent)
    return x.join(y, met & fits).select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")).distinct()


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that similar pairs lead to, itself included.

    A null text, or one without words, has no shingles and is linked with nothing; with fewer than n words the whole sequence
    is the one shingle. Words are runs of non-separators with A-Z lower-cased. Null doc_ids come last in the order of ids;
    repeated rows are documents of their own, linked as their sets are; texts of any length are whole. Other columns are ignored; an
    empty table gives no rows. percent: 1 to 100. Shingles are told apart by 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession)
    found = linked(with_uid(docs, scratch, "text"), scratch, n, percent)
    ids = found.select(F.col("uid").alias("c"), F.col("doc_id").alias("component_id"))
    return found.join(ids, "c").select("doc_id", "n_shingles", "component_id")


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, columns as they are, of which no row before them in the order of doc_id is in their component. Nulls and
    repeats as in join()."""
    scratch = Scratch(docs.sparkSession)
    columns = docs.columns
    held = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(columns)], F.col("doc_id"), F.col("text"))
    keyed = with_uid(held, scratch, *[f"__{i}" for i in range(len(columns))], "text")
    found = linked(keyed.select("uid", "doc_id", "text"), scratch, n, percent)
    copies = scratch.keep(found.filter("uid <> c").select("uid"))
    return keyed.join(copies, "uid", "left_anti").select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(columns)])


def linked(docs: DataFrame, scratch: Scratch, n: int, percent: int) -> DataFrame:
    """uid, doc_id, text -> uid, doc_id, n_shingles, c (the least uid of the component)."""
    parts = partitions(docs.sparkSession)
    coded = prefixes(docs, n, percent, frequency_classes(docs, n))
    coded = scratch.keep(coded.withColumns({"p1": F.xxhash64("prefix"), "p2": F.xxhash64(F.lit(1), "prefix")}))
    group = ["p1", "p2", "n"]
    classes = scratch.keep(coded.filter("n > 0").groupBy("set1", "set2", *group).agg(F.min(F.struct("uid", "sketch")).alias("m")).select("set1", "set2", *group, F.col("m.uid").alias("uid"), F.col("m.sketch").alias("sketch")))
    leaders = classes.groupBy(*group).agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("k"))
    tokens = postings(coded.select("uid", "prefix").join(leaders.select("uid"), "uid", "left_semi"))
    tokens = tokens.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(lean(gathered), "key long, uid long")
    sketches = classes.select("uid", "n", "sketch")
    lists = scratch.keep(tokens.distinct())
    scratch.free()
    # a list of groups stands for all their members, and a group's members are a list of their own
    many = leaders.filter("k > 1").select(*group, F.col("uid").alias("lead"))
    inside = scratch.keep(classes.join(many, group).select(F.xxhash64(F.lit(1), *group).alias("key"), "lead", "uid", "n"))
    own = inside.select("key", "uid", "n")
    others = inside.filter("lead <> uid").select(F.col("lead").alias("l"), F.col("uid").alias("other"), "n")
    sized = scratch.keep(lists.join(sketches.select("uid", "n"), "uid").select("key", "uid", "n"))
    members = sized.select("key", "uid").join(others, F.col("uid") == F.col("l")).select("key", F.col("other").alias("uid"), "n")
    # most documents share no list: what follows reads the sketches of the others only
    sketches = scratch.keep(sketches.join(sized.select("uid").union(own.select("uid")).distinct(), "uid", "left_semi"))
    near = near_lists(sized, percent).union(near_lists(own, percent)).distinct()
    # one candidate for each document is tried first; most are links, and leave nothing to try for the others
    tried = scratch.keep(likely(near, sketches, percent).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = verified(tried, docs, n, percent, scratch)
    found = scratch.keep(components(links, scratch))
    scratch.free()
    left = sized.union(members).union(own)
    for turn in range(RANDOM_ROUNDS + 1):
        left = left.select("key", "uid", "n").join(found.withColumnRenamed("node", "uid"), "uid", "left")
        left = scratch.keep(open_lists(left.withColumn("c", F.coalesce("component", "uid")).drop("component")))
        if turn < RANDOM_ROUNDS:
            pairs = likely(random_neighbours(left, turn, percent), sketches, percent)
        else:
            pairs = across(left, sketches, percent)
        pairs = scratch.keep(pairs.join(tried, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            tried = tried.union(pairs)
            links = links.union(verified(pairs, docs, n, percent, scratch))
            found = scratch.keep(components(links, scratch))
    same = classes.select("set1", "set2", "n", "uid").join(found.withColumnRenamed("node", "uid"), "uid", "left").select("set1", "set2", "n", F.coalesce("component", "uid").alias("component"))
    out = coded.select("uid", "doc_id", "n", "set1", "set2").join(same, ["set1", "set2", "n"], "left")
    return out.select("uid", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "uid").alias("c"))


def op5_jaccard_join(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
reps AS (SELECT h, min(doc_id) AS rep FROM sets GROUP BY h),
r AS (SELECT s.* FROM s JOIN reps ON doc_id = rep),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
c AS (SELECT rep AS v, rep AS u FROM reps UNION SELECT c.v, e.y FROM c JOIN e ON e.x = c.u),
m AS (SELECT v, min(u) AS component FROM c GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN sets USING (doc_id) LEFT JOIN reps USING (h) LEFT JOIN m ON m.v = reps.rep
"""
