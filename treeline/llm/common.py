"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id wherever ids are compared: nulls come after every other id.
NULL_ID = 2**63 - 1


#: Bytes in one Arrow batch to Python workers, about: texts can be long, and a batch is held whole on both sides.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES at most, and Python workers that look for this package where the driver found it (where
    that is another place on the workers, the package is to be installed there or sent along with --py-files). Both stay as they are
    set, as results are lazy and their plans read the settings when they run."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a new local one if the session runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="treeline-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive the loss of executors. Results are lazy and read them, so
    they stay until close(), or until the driver's process ends."""

    def __init__(self, spark: SparkSession) -> None:
        prepare(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/treeline-{uuid.uuid4().hex}"
        self.made, self.tables = 0, []
        atexit.register(self.close)

    def close(self) -> None:
        """Deletes all tables. What was returned from them can't be read any more."""
        atexit.unregister(self.close)
        if self.spark.sparkContext._jsc is None:  # stopped: nothing to ask
            return
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.drop(self.root)

    def write(self, df: DataFrame, codec: str = "zstd") -> tuple[DataFrame, str]:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        return self.write(df, codec)[0]

    def free(self) -> None:
        """Lets Spark delete the shuffle files of finished steps now rather than when memory next runs low."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, path: str) -> None:
        """Deletes a table that no later step reads."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: What a Python worker remembers between tasks.
_remembered: list[dict] = []


def remembered() -> dict:
    """A dictionary of a module, for what its tasks use again; lean() empties it."""
    _remembered.append({})
    return _remembered[-1]


def lean(run):
    """run, for mapInArrow, in a worker that first forgets what other operators remember in it, and afterwards gives free memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if any(_remembered):
            for own in _remembered:
                own.clear()
            gc.collect()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_numbers(spark: SparkSession, count: int, parts: int) -> list[int]:
    """So many numbers that Spark's hash of an int deals evenly to so many partitions; where there are many for each partition chance
    does it."""
    if count > 16 * parts:
        return list(range(count))
    number = F.col("id").cast("int")
    found = spark.range(32 * max(count, parts, 16)).select(number.alias("id"), F.pmod(F.hash(number), F.lit(parts)).alias("part")).collect()
    by_part: dict[int, list[int]] = {}
    for r in sorted(found):
        by_part.setdefault(r.part, []).append(r.id)
    even = [own[i] for i in range(-(-count // parts)) for _, own in sorted(by_part.items()) if i < len(own)]
    taken = set(even)
    return (even + [r.id for r in sorted(found) if r.id not in taken])[:count]


def doc_key(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


# --- words of many texts at once -------------------------------------------------------------------------------------

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
#: Bytes of a run that is hashed eight at a time; longer ones go through blake2b one by one.
_SHORT = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as little-endian integers; zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def low_bytes(n: np.ndarray) -> np.ndarray:
    """Masks of the first n of eight bytes."""
    return _MASKS[np.minimum(n, 8)]


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges. Ranges of one length up to eight never share one; others do by chance only: each step
    scrambles what came before before the next eight bytes are added."""
    n = end - start
    h = mix64((n.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
    if not len(n):
        return h
    wide = eights(data)
    h = mix64(h ^ (wide[start] & low_bytes(n)))
    rest = np.flatnonzero((n > 8) & (n <= _SHORT))
    j = 8
    while len(rest):
        h[rest] = mix64((h[rest] ^ (wide[start[rest] + j] & low_bytes(n[rest] - j))) + np.uint64(j))
        j += 8
        rest = rest[n[rest] > j]
    for i in np.flatnonzero(n > _SHORT).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def _pieces(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about a slice's length that end where a text or a word ends."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(end, at + _SLICE)
        if stop < end:
            k = int(np.searchsorted(offsets, stop, "right")) - 1
            if offsets[k] > at:
                stop = int(offsets[k])
            else:  # one text longer than a slice: cut at its last separator there, or after the word that fills it
                back = np.flatnonzero(_SEPARATOR[data[at:stop]])
                if len(back):
                    stop = at + int(back[-1]) + 1
                else:
                    limit, n = int(offsets[k + 1]), _SLICE
                    while stop < limit:
                        ahead = np.flatnonzero(_SEPARATOR[data[stop : min(limit, stop + n)]])
                        if len(ahead):
                            stop += int(ahead[0]) + 1
                            break
                        stop = min(limit, stop + n)
        yield at, stop
        at = stop


class Words:
    """The words of a batch of texts: 64-bit hashes in text order, byte ranges, and each text's range of words."""

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        if texts.null_count:
            texts = texts.fill_null("")
        kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
        _, offs, data = texts.buffers()
        offsets = np.frombuffer(offs, kind, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data, self.offsets = buf, offsets
        starts, ends, hashes = [], [], []
        for lo, hi in _pieces(offsets, buf):
            part = buf[lo:hi]
            if lower:
                part = _LOWER[part]
            gap = _SEPARATOR[part]
            before, after = np.empty(len(part), bool), np.empty(len(part), bool)
            before[0], before[1:] = True, gap[:-1]
            after[-1], after[:-1] = True, gap[1:]
            inside = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
            before[inside], after[inside[inside > 0] - 1] = True, True
            s, e = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
            hashes.append(byte_hashes(part, s, e))
            starts.append(s + lo)
            ends.append(e + lo)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.bounds[i] : self.bounds[i + 1]]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n entries."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + mix64(hashes[i : i + m] + np.uint64(i * 0x2545F4914F6CDD1D & (2**64 - 1)))
    return mix64(out)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into ones with about so many bytes of text, so that memory doesn't follow the batch size."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), np.int64)
        group = np.cumsum(lengths) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)


# --- documents with a key of their own, and graphs -----------------------------------------------------------------------


def with_uid(rows: DataFrame, scratch: Scratch, *columns: str, key: str = "doc_id") -> DataFrame:
    """uid (long, not null, one of each row, in the order of the key with nulls last), the key, and the columns named.

    Where keys are unique and not null they are the uids. Otherwise rows are sorted and numbered once, in a written table.
    """
    ids = rows.select(F.col(key).cast("long").alias(key))
    odd = ids.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1))
    rows = rows.select(F.col(key).cast("long").alias(key), *columns)
    if odd.isEmpty():
        return rows.select(F.coalesce(key, F.lit(0)).alias("uid"), key, *columns)
    ordered = rows.orderBy(F.col(key).asc_nulls_last()).withColumn("uid", F.monotonically_increasing_id())
    return scratch.keep(ordered).select("uid", key, *columns)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes in links (a, b), by alternating large and small stars.

    Each round joins every node's neighbours to the least of them; rounds grow as the logarithm of the number of nodes. A round
    aggregates before it shuffles, and nothing but two sums comes to the driver.
    """
    edges, path = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        old = path
        edges, path = scratch.write(small.filter("u <> v").distinct())
        scratch.drop(old)
