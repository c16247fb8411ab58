"""Sums and minima over all documents by messages between chunks of documents and buckets of keys.

Documents are dealt once into chunks, in a table bucketed by chunk. In each round a chunk sends every bucket its sorted distinct
keys with a number for each, and gets back an answer for each in the same order. So a key's traffic is one number a chunk,
however frequent it is; documents are shuffled once; and answers are kept in tables bucketed like the chunks, so that later
rounds join them without a shuffle. All is in tables that survive the loss of executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, even_numbers, partitions

#: Words of the corpus for each bucket of keys.
BUCKET = 1 << 20


def planes(values: np.ndarray) -> bytes:
    """Whole numbers below 2**64: their width in bytes, then all lowest bytes, all second bytes, and so on."""
    v = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return bytes((width,)) + np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    width = raw[0]
    part = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((part.shape[1], 8), np.uint8)
    out[:, :width] = part.T
    return out.view("<u8").reshape(-1)


def steps(keys: np.ndarray) -> bytes:
    """Ascending numbers, as the steps between them."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unstepped(raw: bytes) -> np.ndarray:
    return np.cumsum(unplaned(raw), dtype=np.uint64)


def bits(yes: np.ndarray) -> bytes:
    return np.packbits(yes).tobytes()


def unpacked_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def split(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets, which are equal ranges of 64-bit keys, in ascending keys."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64) if buckets > 1 else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def sent(keys: np.ndarray, buckets: int, *encoders: Callable[[slice], bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Each bucket that has keys, the keys' steps, and what the encoders make of the bucket's range."""
    bounds = split(keys, buckets)
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        part = slice(int(bounds[b]), int(bounds[b + 1]))
        yield b, [steps(keys[part]), *(make(part) for make in encoders)]


def merged(n: int, bounds: np.ndarray, replies: list[dict], decode: Callable[[bytes, int], np.ndarray], kind) -> np.ndarray:
    """The answers for all n keys of a chunk, put together from its buckets' replies."""
    out = np.zeros(n, kind)
    for r in replies:
        lo, hi = int(bounds[r["bucket"]]), int(bounds[r["bucket"] + 1])
        out[lo:hi] = decode(r["reply"], hi - lo)
    return out


class Received:
    """A bucket's messages in the order of chunks: keys one after another, each key's place among the distinct ones, and ends."""

    def __init__(self, messages: pa.Table) -> None:
        messages = messages.sort_by("chunk")
        self.messages, self.chunk, self.bucket = messages, messages.column("chunk"), messages.column("bucket")
        keys = [unstepped(raw) for raw in messages.column("m0").to_pylist()]
        self.ends = np.cumsum([len(k) for k in keys])
        self.keys = np.concatenate(keys)

    def column(self, i: int, decode: Callable[[bytes], np.ndarray] = unplaned) -> np.ndarray:
        return np.concatenate([decode(raw) for raw in self.messages.column(f"m{i}").to_pylist()])

    def flags(self, i: int) -> np.ndarray:
        sizes = np.diff(self.ends, prepend=0).tolist()
        return np.concatenate([unpacked_bits(raw, n) for raw, n in zip(self.messages.column(f"m{i}").to_pylist(), sizes)])

    def replies(self, answers: np.ndarray, encode: Callable[[np.ndarray], bytes], distinct: int, total: int) -> pa.Table:
        """The answers for each chunk; two numbers for the whole bucket go with the first."""
        parts = np.split(answers, self.ends[:-1])
        rest = [0] * (len(parts) - 1)
        return pa.table({
            "chunk": self.chunk, "bucket": self.bucket, "reply": pa.array([encode(p) for p in parts], pa.binary()),
            "distinct": pa.array([int(distinct), *rest], pa.int64()), "total": pa.array([int(total), *rest], pa.int64()),
        })


class Chunks:
    """rows: chunk (long), n (words, long) and other columns, a row for each chunk."""

    def __init__(self, rows: DataFrame, scratch: Scratch) -> None:
        self.spark, self.scratch = rows.sparkSession, scratch
        self.parts = partitions(self.spark)
        self.base = self._table(rows.repartition(self.parts, "chunk"))
        self.replies: dict[str, DataFrame] = {}
        scratch.free()
        self.words = self.base.agg(F.sum("n")).first()[0] or 0
        self.buckets = max(self.parts, -(-self.words // BUCKET))
        self.places = even_numbers(self.spark, self.buckets, self.parts)

    def _table(self, rows: DataFrame) -> DataFrame:
        name = f"treeline_{uuid.uuid4().hex}"
        self.scratch.tables.append(name)
        writer = rows.write.option("compression", "zstd").option("path", f"{self.scratch.root}/{name}")
        writer.bucketBy(self.parts, "chunk").sortBy("chunk").saveAsTable(name)
        return self.spark.table(name)

    def joined(self) -> DataFrame:
        """Chunks with the replies of all rounds so far."""
        out = self.base
        for name, rows in self.replies.items():
            out = out.join(rows, "chunk", "left")
            out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
        return out

    def each(self, make: Callable[[dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from make(batch.slice(i, 1).to_pylist()[0])

        return self.joined().mapInArrow(run, schema)

    def exchange(self, name: str, columns: int, send: Callable[[dict], Iterator[tuple[int, list[bytes]]]], reduce: Callable[[pa.Table], pa.Table]) -> tuple[int, int]:
        """A round: send gives a chunk's messages (bucket, so many columns), reduce a bucket's replies. Gives the sums of the two
        numbers of all buckets."""
        names, places = [f"m{i}" for i in range(columns)], self.places

        def run(row: dict) -> Iterator[pa.RecordBatch]:
            found = list(send(row))
            if found:
                body = [pa.array([m[i] for _, m in found], pa.binary()) for i in range(columns)]
                ids = [pa.array([places[b] for b, _ in found], pa.int32()), pa.array([b for b, _ in found], pa.int32()), pa.array([row["chunk"]] * len(found), pa.int64())]
                yield pa.RecordBatch.from_arrays([*ids, *body], ["place", "bucket", "chunk", *names])

        out = self.each(run, f"place int, bucket int, chunk long, {', '.join(f'{n} binary' for n in names)}")
        out = out.groupBy("place").applyInArrow(reduce, "chunk long, bucket int, reply binary, distinct long, total long")
        out = out.repartition(self.parts, "chunk").groupBy("chunk")
        made = self._table(out.agg(F.collect_list(F.struct("bucket", "reply")).alias(name), F.sum("distinct").alias("distinct"), F.sum("total").alias("total")))
        self.replies[name] = made.select("chunk", name)
        self.scratch.free()
        sums = made.agg(F.sum("distinct"), F.sum("total")).first()
        return sums[0] or 0, sums[1] or 0
