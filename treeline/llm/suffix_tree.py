"""Language-model scores by a probabilistic suffix tree over words.

A state of the tree is a context of up to DEPTH words; the root is the smoothed distribution of single words. A context is a
candidate if it is seen twice, and is retained if a divergence test says that what follows it differs from what its own
suffix predicts: the gain in log-likelihood of its occurrences, each scored without itself, for the best of a few weights of
smoothing. A word is scored in the state of the longest retained suffix of what precedes it; each state's distribution is
mixed with its suffix's, down to the root, so it sums to one.

How it runs: texts are turned once into chunks of word numbers, each with a dictionary of its words, and all counts and gains
are summed by messages between chunks and buckets of keys. All counts are over all training documents, and nothing of the
vocabulary comes to the driver. Words and contexts are told apart by 64-bit hashes; counts are whole numbers of 64 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, mix64, slices, table
from .messages import Chunks, Received, bits, merged, planes, sent, split, unpacked_bits, unplaned

DEPTH = 2
#: Occurrences in training that make a context a candidate: one alone says nothing about itself.
SEEN = 2
WEIGHTS = (2.0, 30.0, 400.0)
#: Least gain in nats, in all and for each occurrence.
GAIN, GAIN_EACH = 5.0, 0.005
CHUNK = 1 << 19
END = np.uint64(0xE4D0F7E27C15A5A5)
_K = np.uint64(0xD6E8FEB86659FD93)


def packed(ids: np.ndarray) -> bytes:
    """Numbers below 2**32 as planes of their low and high halves, compressed."""
    v = ids.astype(np.uint32)
    return zlib.compress((v & 0xFFFF).astype(np.uint16).tobytes() + (v >> 16).astype(np.uint16).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    low, high = np.frombuffer(zlib.decompress(raw), np.uint16).reshape(2, -1)
    return low | high.astype(np.uint32) << np.uint32(16)


def chunked(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """doc_id, held, text -> a row for each chunk of about size words (whole documents): words (sorted distinct hashes), ids (a
    number for each word and each document's end), bounds, doc_ids, held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        hashes, sizes, doc_ids, held, total = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal hashes, sizes, doc_ids, held, total, made
            words, ids = np.unique(np.concatenate(hashes), return_inverse=True)
            row = [[base + made], [words.tobytes()], [packed(ids)], [np.cumsum([0, *sizes]).tobytes()], [doc_ids], [np.array(held, np.uint8).tobytes()], [total]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int64()]
            made += 1
            hashes, sizes, doc_ids, held, total = [], [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["chunk", "words", "ids", "bounds", "doc_ids", "held", "n"])

        for batch in slices(batches):
            words = Words(batch.column("text"), lower=True)
            with_end = np.insert(words.hash, words.bounds[1:], END)
            hashes.append(with_end)
            sizes.extend((np.diff(words.bounds) + 1).tolist())
            doc_ids.extend(batch.column("doc_id").to_pylist())
            held.extend(batch.column("held").to_pylist())
            total += len(with_end)
            if total >= size:
                yield flush()
        if total:
            yield flush()

    return docs.mapInArrow(run, "chunk long, words binary, ids binary, bounds binary, doc_ids array<long>, held binary, n long")


class Chunk:
    """A chunk's row and what has come back for it: counts of words (r0), then for each depth counts of pairs (r1, ...) and which
    contexts are states (s1, ...)."""

    def __init__(self, row: dict, buckets: int, tokens: int, distinct: int, least: int = SEEN) -> None:
        self.least = least
        self.words = np.frombuffer(row["words"], np.uint64)
        self.ids = unpacked(row["ids"])
        self.bounds = np.frombuffer(row["bounds"], np.int64)
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.doc_ids, self.buckets = row["doc_ids"], buckets
        sizes = np.diff(self.bounds)
        self.train = np.repeat(~self.held, sizes)
        self.hash = self.words[self.ids]
        self.place = np.arange(len(self.ids)) - np.repeat(self.bounds[:-1], sizes)
        if row.get("r0") is None:
            return
        self.known = self._counts(self.words, row["r0"])[self.ids]
        self.base = (self.known + 1.0) / (tokens + distinct + 1.0)
        self.p = self.base
        self.context = np.zeros(0, np.uint64)
        self.depth = 0
        self._next()
        while row.get(f"r{self.depth}") is not None:
            self.both = np.zeros(len(self.ids))
            self.both[self.at] = self._counts(self.keys, row[f"r{self.depth}"])[self.back]
            if (states := row.get(f"s{self.depth}")) is None:
                return
            self._apply(states)
            self._next()

    def _counts(self, keys: np.ndarray, replies: list[dict]) -> np.ndarray:
        return merged(len(keys), split(keys, self.buckets), replies, lambda raw, _: unplaned(raw), np.float64)

    def _next(self) -> None:
        """Candidate contexts of the next depth: the places (at) that have one, its hash and count, and the keys of pairs."""
        self.depth += 1
        n = len(self.ids)
        count = np.zeros(n)
        context = np.zeros(n, np.uint64)
        if self.depth == 1:
            count[1:], context[1:] = self.known[:-1], self.hash[:-1]
        else:
            count[1:] = self.both[:-1]
            context[1:] = mix64(self.context[:-1] * _K + self.hash[:-1])
        self.context = context
        self.at = np.flatnonzero((count >= self.least) & (self.place >= self.depth))
        self.seen = count[self.at]
        self.keys, self.back = np.unique(mix64(context[self.at] * _K + mix64(self.hash[self.at] + np.uint64(self.depth))), return_inverse=True)

    def word_messages(self) -> Iterator[tuple[int, list[bytes]]]:
        counts = np.bincount(self.ids[self.train], minlength=len(self.words))
        return sent(self.words, self.buckets, lambda part: planes(counts[part]))

    def pair_messages(self) -> Iterator[tuple[int, list[bytes]]]:
        counts = np.bincount(self.back[self.train[self.at]], minlength=len(self.keys))
        return sent(self.keys, self.buckets, lambda part: planes(counts[part]))

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct candidate contexts, and which of them each place (in at) has."""
        return np.unique(self.context[self.at], return_inverse=True)

    def gain_messages(self) -> Iterator[tuple[int, list[bytes]]]:
        """Contexts, their occurrences here, and their gains here for each weight."""
        own, back = self.contexts()
        use = self.train[self.at]
        p, both = self.p[self.at], self.both[self.at]
        times = np.bincount(back[use], minlength=len(own))
        gain = []
        for w in WEIGHTS:
            with np.errstate(divide="ignore", invalid="ignore"):
                each = np.log((both - 1 + w * p) / (self.seen - 1 + w)) - np.log(p)
            gain.append(np.bincount(back[use], weights=each[use], minlength=len(own)).astype("<f4"))
        return sent(own, self.buckets, lambda part: planes(times[part]), lambda part: b"".join(g[part].tobytes() for g in gain))

    def _apply(self, states: list[dict]) -> None:
        """Replies: for each context whether it is a state, then the place of its weight (0 where it is none)."""
        own, back = self.contexts()
        weight = merged(len(own), split(own, self.buckets), states, _decided, np.uint8)[back]
        hit = weight > 0
        if not hit.any():
            return
        at, w = self.at[hit], np.array((0.0, *WEIGHTS))[weight[hit]]
        p = self.p.copy()
        p[at] = (self.both[at] + w * p[at]) / (self.seen[hit] + w)
        self.p = p

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        firsts = self.bounds[:-1]
        return np.add.reduceat((self.known > 0).astype(np.int64), firsts), np.add.reduceat(np.log10(self.base), firsts), np.add.reduceat(np.log10(self.p), firsts)


def _decided(raw: bytes, n: int) -> np.ndarray:
    size = -(-n // 8)
    return unpacked_bits(raw[:size], n).astype(np.uint8) + 2 * unpacked_bits(raw[size:], n).astype(np.uint8)


def add_up(messages: pa.Table) -> pa.Table:
    """Counts of each key over all chunks; and the number of keys that were counted and the sum of all counts."""
    got = Received(messages)
    own, back = np.unique(got.keys, return_inverse=True)
    order = np.argsort(back, kind="stable")
    total = np.add.reduceat(got.column(1)[order], np.searchsorted(back[order], np.arange(len(own))))
    return got.replies(total[back], planes, (total > 0).sum(), total.sum())


def choose(messages: pa.Table) -> pa.Table:
    """Which contexts are retained, and the place of their weight from 1 on; and how many are."""
    got = Received(messages)
    own, back = np.unique(got.keys, return_inverse=True)
    times = np.bincount(back, weights=got.column(1), minlength=len(own))
    gains = got.column(2, lambda raw: np.frombuffer(raw, "<f4").reshape(len(WEIGHTS), -1).T)
    total = np.stack([np.bincount(back, weights=gains[:, i], minlength=len(own)) for i in range(len(WEIGHTS))], axis=1)
    best = total.max(axis=1)
    good = (best > GAIN) & (best > GAIN_EACH * times)
    place = np.where(good, total.argmax(axis=1) + 1, 0)
    return got.replies(place[back], lambda x: bits(x & 1 > 0) + bits(x & 2 > 0), good.sum(), 0)


class Learner:
    def __init__(self, docs: DataFrame, depth: int = DEPTH, least: int = SEEN, chunk: int = CHUNK) -> None:
        self.least = max(2, least)
        self.scratch = Scratch(docs.sparkSession)
        held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
        rows = chunked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), "text"), chunk)
        self.chunks = Chunks(rows, self.scratch)
        self.tokens = self.distinct = 0
        self.distinct, self.tokens = self.chunks.exchange("r0", 2, self._of("word_messages"), add_up)
        for d in range(1, depth + 1):
            pairs, _ = self.chunks.exchange(f"r{d}", 2, self._of("pair_messages"), add_up)
            if not pairs:  # no context is left that could have a longer one
                del self.chunks.replies[f"r{d}"]
                break
            self.chunks.exchange(f"s{d}", 3, self._of("gain_messages"), choose)

    def _made(self):
        buckets, tokens, distinct, least = self.chunks.buckets, self.tokens, self.distinct, self.least
        return lambda row: Chunk(row, buckets, tokens, distinct, least)

    def _of(self, name: str):
        make = self._made()
        return lambda row: getattr(make(row), name)()

    def scores(self) -> DataFrame:
        tokens = self.tokens

        make = self._made()

        def run(row: dict) -> Iterator[pa.RecordBatch]:
            own = make(row)
            known, base, score = own.scores()
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.doc_ids, pa.int64()), pa.array(own.held), pa.array(np.diff(own.bounds)), pa.array(known), pa.array(np.full(len(known), tokens, np.int64)), pa.array(base), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        return self.chunks.each(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, depth: int = DEPTH, least: int = SEEN, chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    A null text has its end alone. A null doc_id is not held out. Repeated rows each count in training and get a row each. An
    empty table gives no rows; other columns are ignored. A text of any length is whole in one chunk. depth: words of the
    longest contexts, any number; least: occurrences that make a context a candidate, two at least; chunk: words that are
    numbered together. Where nothing is held in training, all words are unknown and the root has one outcome.
    """
    return Learner(docs, depth, least, chunk).scores()


def op9_suffix_tree(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
