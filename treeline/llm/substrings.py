"""Substring dedup by level-wise doubling.

Windows repeated at one length alone are extended to twice that length. For windows of n words the lengths are n, its half
(rounded up), that one's half, and so on down to FIRST words at least, taken from the shortest. At each length k but the last,
a window of n words stands by the k words in it whose hash is least (equal windows agree on them, so a part of the places is
looked at); windows whose k words begin in one document only are dropped, and the rest go on to the next length, until none is
left or the length is n. There each window's least document is found, and a document loses the windows that begin in a smaller
one.

Documents are dealt once into chunks; repeated words and least documents are found by messages between chunks and buckets of
hashes, one for each distinct window of a chunk, so that a passage in a third of all documents costs one number a chunk. Windows
are compared by two hashes of 96 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, Words, doc_key, grams, slices, table
from .messages import Chunks, Received, bits, merged, planes, sent, split, unpacked_bits, unplaned

WINDOW = 13
#: Words of the shortest length that is looked at: shorter runs are repeated nearly everywhere, and leave nothing out.
FIRST = 6
CHUNK = 1 << 19


def lengths(n: int, first: int = FIRST) -> list[int]:
    """From the shortest to n, each half of the next, rounded up."""
    out = [n]
    while (out[0] + 1) // 2 >= first and out[0] > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def chunked(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """doc_id, doc (its key), text -> a row for each chunk of about size words (whole documents): the texts together, their offsets,
    doc_ids, keys, and the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        texts, offsets, doc_ids, keys, total = [], [0], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal texts, offsets, doc_ids, keys, total, made
            row = [[base + made], [b"".join(texts)], [np.array(offsets, np.int64).tobytes()], [doc_ids], [np.array(keys, np.int64).tobytes()], [total]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int64()]
            texts, offsets, doc_ids, keys, total, made = [], [0], [], [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["chunk", "text", "offsets", "doc_ids", "docs", "n"])

        for batch in slices(batches):
            words = Words(batch.column("text"))
            for i, (text, doc_id, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id", "doc")))):
                texts.append((text or "").encode())
                offsets.append(offsets[-1] + len(texts[-1]))
                doc_ids.append(doc_id)
                keys.append(key)
                total += int(words.bounds[i + 1] - words.bounds[i])
                if total >= size or offsets[-1] >= 16 * size:
                    yield flush()
        if doc_ids:
            yield flush()

    return docs.mapInArrow(run, "chunk long, text binary, offsets binary, doc_ids array<long>, docs binary, n long")


class Chunk:
    """A chunk's row: its words, and the windows of n words that have come through the lengths whose replies it holds."""

    def __init__(self, row: dict, n: int, steps: list[int], buckets: int) -> None:
        self.n, self.buckets, self.doc_ids = n, buckets, row["doc_ids"]
        self.docs = np.frombuffer(row["docs"], np.int64)
        offsets = np.frombuffer(row["offsets"], np.int64)
        self.words = Words(pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(row["text"])]))
        self.doc = np.repeat(np.arange(len(self.docs)), np.diff(self.words.bounds))
        last = len(self.doc) - n + 1
        self.first = np.flatnonzero(self.doc[:last] == self.doc[n - 1 :]) if last > 0 else np.zeros(0, np.int64)
        for k in steps:
            self._shorten(k)
            if (replies := row.get(f"k{k}")) is None:
                return
            repeated = merged(len(self.keys), split(self.keys, buckets), replies, unpacked_bits, bool)
            self.first = self.first[repeated[self.back]]
        self.window = grams(self.words.hash, n)[self.first]

    def _shorten(self, k: int) -> None:
        """For each window the k words of least hash in it: the distinct ones, and which each window has."""
        runs = grams(self.words.hash, k)
        least = runs[self.first]
        for j in range(1, self.n - k + 1):
            np.minimum(least, runs[self.first + j], out=least)
        self.keys, self.back = np.unique(least, return_inverse=True)

    def run_messages(self) -> Iterator[tuple[int, list[bytes]]]:
        """The distinct runs of this length, and whether several documents here have them."""
        doc = self.docs[self.doc[self.first]]
        low, high = np.full(len(self.keys), NULL_ID), np.full(len(self.keys), -NULL_ID - 1)
        np.minimum.at(low, self.back, doc)
        np.maximum.at(high, self.back, doc)
        return sent(self.keys, self.buckets, lambda part: bits(low[part] < high[part]))

    def distinct_windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct windows in the order of both hashes, the least document of each here, and which each window is."""
        runs = grams(self.words.hash, (self.n + 1) // 2)
        second = (runs[self.first] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((second, self.window))
        w, s = self.window[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1])
        starts = np.flatnonzero(new)
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(self.docs[self.doc[self.first[order]]], starts) if len(starts) else np.zeros(0, np.int64)
        return w[new], s[new], least, back

    def window_messages(self) -> Iterator[tuple[int, list[bytes]]]:
        own, second, least, _ = self.distinct_windows()

        def documents(part: slice) -> bytes:
            low = least[part].min()
            return int(low).to_bytes(8, "little", signed=True) + planes(least[part].view(np.uint64) - np.uint64(int(low) & (1 << 64) - 1))

        return sent(own, self.buckets, lambda part: second[part].tobytes(), documents)

    def kept(self, replies: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Which words stay, and how many of each document go."""
        own, _, least, back = self.distinct_windows()
        elsewhere = merged(len(own), split(own, self.buckets), replies, unpacked_bits, bool)
        gone = self.first[elsewhere[back] | (self.docs[self.doc[self.first]] > least[back])]
        edges = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(edges, gone, 1)
        np.add.at(edges, gone + self.n, -1)
        stay = np.cumsum(edges[:-1]) == 0
        return stay, np.bincount(self.doc[~stay], minlength=len(self.docs))

    def texts(self, stay: np.ndarray) -> pa.Array:
        """Each document's words that stay, joined by one space."""
        at = np.flatnonzero(stay)
        start, size, doc = self.words.start[at], self.words.end[at] - self.words.start[at] + 1, self.doc[at]
        ends = np.cumsum(size)
        flat = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
        data = np.append(self.words.data, np.uint8(32))[flat]
        data[ends - 1] = 32
        bounds = np.concatenate([[0], ends])[np.searchsorted(doc, np.arange(len(self.docs) + 1))]
        keep = np.ones(len(data), bool)  # no space after a document's last word
        some = np.flatnonzero(np.diff(bounds))
        keep[bounds[some + 1] - 1] = False
        drop = np.concatenate([[0], np.cumsum(np.diff(bounds) > 0)])
        return pa.Array.from_buffers(pa.large_string(), len(self.docs), [None, pa.py_buffer((bounds - drop).astype(np.int64)), pa.py_buffer(data[keep])])


def common_runs(messages: pa.Table) -> pa.Table:
    """Which runs several documents or chunks have; and how many do."""
    got = Received(messages)
    own, back, chunks = np.unique(got.keys, return_inverse=True, return_counts=True)
    many = chunks > 1
    many[back[got.flags(1)]] = True
    return got.replies(many[back], bits, many.sum(), 0)


def smaller_elsewhere(messages: pa.Table) -> pa.Table:
    """Which windows begin in a smaller document than the least of the chunk that asks; and for how many chunks."""
    got = Received(messages)
    second = got.column(1, lambda raw: np.frombuffer(raw, np.uint32))
    doc = got.column(2, lambda raw: (unplaned(raw[8:]) + np.uint64(int.from_bytes(raw[:8], "little"))).view(np.int64))
    order = np.lexsort((second, got.keys))
    w, s = got.keys[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1])
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.empty(len(order), bool)
    out[order] = least < doc[order]
    return got.replies(out, bits, out.sum(), 0)


def without_repeats(docs: DataFrame, n: int = WINDOW, first: int = FIRST, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each word is removed that a window of n words (any number from 1 on) covers whose words
    also start in a document with a smaller doc_id. Windows are judged on the input.

    A null text has no words; a null doc_id counts as larger than all others; rows of one doc_id are one document to each other
    (neither is removed for the other's sake); texts with fewer than n words stay whole, texts of any length are whole in one
    chunk; other columns are ignored; an empty table gives no rows.
    """
    if n < 1:
        raise ValueError("a window has a word at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("doc"), "text")
    chunks = Chunks(chunked(rows, chunk), Scratch(docs.sparkSession))
    steps, buckets, done = lengths(n, first), chunks.buckets, []
    for k in steps[:-1]:
        done.append(k)
        found, _ = chunks.exchange(f"k{k}", 2, lambda row, tried=tuple(done): Chunk(row, n, tried, buckets).run_messages(), common_runs)
        if not found:
            break
    whole = tuple(done)
    if not done or found:
        chunks.exchange("windows", 3, lambda row: Chunk(row, n, whole, buckets).window_messages(), smaller_elsewhere)

    def run(row: dict) -> Iterator[pa.RecordBatch]:
        own = Chunk(row, n, whole, buckets)
        stay, gone = own.kept(row.get("windows") or [])
        yield pa.RecordBatch.from_arrays([pa.array(own.doc_ids, pa.int64()), pa.array(np.diff(own.words.bounds)), pa.array(gone), own.texts(stay).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return chunks.each(run, "doc_id long, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark, sf_dir):
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM p),
m AS (SELECT g, min(doc_id) AS first FROM h GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM h JOIN m USING (g) WHERE doc_id > first),
g AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS x,
             CASE WHEN gone IS NULL THEN w ELSE list_filter(list_transform(w, lambda v, j: CASE WHEN list_contains(gone, j) THEN NULL ELSE v END), lambda v: v IS NOT NULL) END AS kept
      FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(x AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
