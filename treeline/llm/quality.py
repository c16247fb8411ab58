"""Quality by a linear-chain conditional random field over lines.

Each line is good or bad; features are bins of a few shape measures of the line and of the lines before and after it. The field
is trained on documents whose lines all take the document's label. A document's quality is the mean of its lines'
marginal probabilities of being good, weighted by their lengths, from a forward and a backward pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, prepare, slices, table

#: Labelled documents that training reads at most: those with the least hash of doc_id.
TRAINING_DOCS = 3000
STEPS, RATE, RIDGE = 250, 0.1, 1e-3
THRESHOLD = 0.7
BINS = 8
_CUTS = {
    "length": [1, 8, 20, 40, 80, 160, 400],
    "upper": [0.001, 0.02, 0.05, 0.1, 0.3, 0.6, 0.9],
    "digit": [0.001, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5],
    "mark": [0.001, 0.01, 0.03, 0.05, 0.1, 0.2, 0.4],
    "stop": [0.001, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2],
    "foreign": [0.001, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5],
    "word": [2, 3, 4, 5, 6, 8, 12],
    "fresh": [0.2, 0.4, 0.6, 0.75, 0.85, 0.92, 0.97],
    "tail": [0.01, 0.05, 0.1, 0.2, 0.4, 0.7, 0.9],
    "copies": [1, 2, 3, 4, 6, 10, 20],
}
FEATURES = len(_CUTS)
_UPPER, _LETTER, _DIGIT, _MARK, _STOP, _WIDE, _BEGIN = (np.zeros(256, bool) for _ in range(7))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_STOP[[ord(c) for c in ".,;:'\"()-"]] = True
_MARK[33:127] = True
_MARK &= ~(_LETTER | _DIGIT | _STOP)
_WIDE[128:] = True
_BEGIN[:] = True
_BEGIN[128:192] = False


class Lines:
    """Lines of a batch of texts: bins (lines x FEATURES), lengths in code points, and each text's range of lines. A text without
    characters has one empty line."""

    def __init__(self, texts: pa.Array) -> None:
        words = Words(texts)
        data, offsets = words.data, words.offsets
        base, end = int(offsets[0]), int(offsets[-1])
        part = data[base:end]
        breaks = np.flatnonzero(part == 10) + base
        edges = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
        if len(breaks):  # a text's first byte begins a line of its own even where the text before it ended with a break
            at_start = np.isin(breaks + 1, offsets[1:])
            edges = np.sort(np.concatenate([offsets[:-1], breaks[~at_start] + 1]))
        starts, ends = edges, np.append(edges[1:], end)
        n = len(starts)

        def per(mask: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mask[part])])
            return (sums[ends - base] - sums[starts - base]).astype(float)

        self.bounds = np.concatenate([np.searchsorted(starts, offsets[:-1], "left"), [n]])
        for i in np.flatnonzero(np.diff(offsets) == 0):  # equal starts: empty texts come before the text that holds the bytes
            self.bounds[i] = np.searchsorted(starts, offsets[i], "left") + (i - np.searchsorted(offsets[:-1], offsets[i], "left"))
        for i in np.flatnonzero((np.diff(offsets) > 0) & np.concatenate([[False], np.diff(offsets)[:-1] == 0])):
            self.bounds[i] = np.searchsorted(starts, offsets[i], "right") - 1
        chars = per(_BEGIN)
        some = np.maximum(chars, 1)
        letters = per(_LETTER)
        first = np.searchsorted(words.start, starts, "left")
        last = np.searchsorted(words.start, ends, "left")
        count = (last - first).astype(float)
        line_of = np.repeat(np.arange(n), last - first)
        distinct = np.zeros(n)
        copies = np.ones(n)
        if len(words.hash):
            order = np.lexsort((words.hash, line_of))
            h, l = words.hash[order], line_of[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (l[1:] != l[:-1])])
            distinct = np.bincount(l[new], minlength=n).astype(float)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(words.hash * (np.uint64(2) * (np.arange(len(words.hash)) - first[line_of]).astype(np.uint64) + np.uint64(1)))])
            text_of = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
            whole = sums[last] - sums[first]
            order = np.lexsort((whole, text_of))
            new = np.concatenate([[True], (whole[order][1:] != whole[order][:-1]) | (text_of[order][1:] != text_of[order][:-1])])
            run = np.cumsum(new) - 1
            copies[order] = np.bincount(run)[run]
        closing = data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
        tails = np.bincount(line_of, weights=(_MARK[closing]).astype(float), minlength=n)
        values = {
            "length": chars, "upper": per(_UPPER) / np.maximum(letters, 1), "digit": per(_DIGIT) / some, "mark": per(_MARK) / some, "stop": per(_STOP) / some,
            "foreign": per(_WIDE) / np.maximum(ends - starts, 1), "word": chars / np.maximum(count, 1), "fresh": distinct / np.maximum(count, 1), "tail": tails / np.maximum(count, 1), "copies": copies,
        }
        self.bins = np.stack([np.searchsorted(np.array(_CUTS[k], float), values[k], "right") for k in _CUTS], axis=1).astype(np.uint8)
        self.length = np.maximum(chars, 1e-9)


class Field:
    """own, before, after: (FEATURES, BINS) weights of a good line against a bad one; step[i, j]: from i to j (0 bad, 1 good)."""

    def __init__(self, own, before, after, start, step) -> None:
        self.own, self.before, self.after, self.start, self.step = own, before, after, start, step

    @classmethod
    def empty(cls) -> Field:
        return cls(*(np.zeros((FEATURES, BINS)) for _ in range(3)), np.zeros(2), np.zeros((2, 2)))

    def scores(self, bins: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log odds of each line by its own and its neighbours' features."""
        k = np.arange(FEATURES)
        out = self.own[k, bins].sum(axis=1)
        inner = np.ones(len(bins), bool)
        inner[bounds[:-1][bounds[:-1] < len(bins)]] = False
        at = np.flatnonzero(inner)
        out[at] += self.before[k, bins[at - 1]].sum(axis=1)
        out[at - 1] += self.after[k, bins[at]].sum(axis=1)
        return out

    def marginals(self, odds: np.ndarray, bounds: np.ndarray, pairs: bool = False):
        """P(good) of each line; with pairs also the expected steps of all texts together, expected starts, and log partition."""
        lengths = np.diff(bounds)
        order = np.argsort(-lengths, kind="stable")
        firsts, n = bounds[:-1][order], np.sort(lengths)[::-1]
        step, start = np.exp(self.step), np.exp(self.start)
        top = np.maximum(odds, 0)
        local = np.stack([np.exp(-top), np.exp(odds - top)], axis=1)
        forward, scale = np.empty((len(odds), 2)), np.empty(len(odds))
        active = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")
        for t, k in enumerate(active):
            at = firsts[:k] + t
            now = (start if t == 0 else forward[at - 1] @ step) * local[at]
            scale[at] = now.sum(axis=1)
            forward[at] = now / scale[at][:, None]
        backward = np.ones((len(odds), 2))
        moves = np.zeros((2, 2))
        for t in range(len(active) - 2, -1, -1):
            at = firsts[: active[t + 1]] + t
            ahead = local[at + 1] * backward[at + 1] / scale[at + 1][:, None]
            backward[at] = ahead @ step.T
            if pairs:
                moves += (forward[at].T @ ahead) * step
        good = forward * backward
        good = good[:, 1] / good.sum(axis=1)
        return (good, moves, float(np.log(scale).sum() + top.sum())) if pairs else good

    def quality(self, lines: Lines) -> np.ndarray:
        good = self.marginals(self.scores(lines.bins, lines.bounds), lines.bounds)
        firsts = lines.bounds[:-1]
        return np.clip(np.add.reduceat(good * lines.length, firsts) / np.add.reduceat(lines.length, firsts), 0.0, 1.0)


def train(bins: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> Field:
    """Maximises the ridge-penalised conditional likelihood by Adam; deterministic."""
    field = Field.empty()
    if not len(labels):
        return field
    lengths = np.diff(bounds)
    y = np.repeat(labels, lengths).astype(float)
    inner = np.ones(len(bins), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    flat = bins.astype(np.int64) + BINS * np.arange(FEATURES)
    seen_moves = np.zeros((2, 2))
    for c in (0, 1):
        seen_moves[c, c] = float((lengths - 1)[labels == c].sum())
    seen_start = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    names = ("own", "before", "after", "start", "step")
    size, m, v = len(bins), {}, {}

    def spread(diff: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.bincount(rows.reshape(-1), weights=np.repeat(diff, FEATURES), minlength=FEATURES * BINS).reshape(FEATURES, BINS)

    for i in range(1, STEPS + 1):
        good, moves, _ = field.marginals(field.scores(bins, bounds), bounds, pairs=True)
        diff = y - good
        first = good[bounds[:-1]]
        slope = {"own": spread(diff, flat), "before": spread(diff[at], flat[at - 1]), "after": spread(diff[at - 1], flat[at]), "start": seen_start - np.array([(1 - first).sum(), first.sum()]), "step": seen_moves - moves}
        for k in names:
            g = slope[k] / size - RIDGE * getattr(field, k)
            m[k] = 0.9 * m.get(k, 0.0) + 0.1 * g
            v[k] = 0.99 * v.get(k, 0.0) + 0.01 * g * g
            setattr(field, k, getattr(field, k) + RATE * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-9))
    return field


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCS) -> Field:
    """From at most so many labelled documents, none of them held out, each once: of rows of one doc_id the one whose text has the
    least hash. Rows without a label of 0 or 1 are passed over."""
    prepare(docs.sparkSession)
    chosen = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null").filter(~held_out())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines = Lines(batch.column("text"))
            bins = [lines.bins[a:b].tobytes() for a, b in zip(lines.bounds, lines.bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(bins, pa.binary())], ["doc_id", "quality", "bins"])

    found = sorted((r.doc_id, r.quality, bytes(r.bins)) for r in rows.mapInArrow(run, "doc_id long, quality int, bins binary").collect())
    bins = np.frombuffer(b"".join(b for _, _, b in found), np.uint8).reshape(-1, FEATURES)
    bounds = np.cumsum([0, *(len(b) // FEATURES for _, _, b in found)])
    return train(bins, bounds, np.array([q for _, q, _ in found], np.int64))


def score(docs: DataFrame, field: Field, name: str = "score") -> DataFrame:
    """The rows of docs with a column of this name (double) added. Null and empty texts are one empty line; repeated rows get a score
    each; an empty table gives no rows."""
    from pyspark.sql import types as T

    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = shared.value.quality(Lines(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    A null or empty text is one empty line and gets that line's probability. A null doc_id is not held out. Repeated rows get
    a score each. Without usable labels every score is 0.5. A text of any length is scored whole. An empty table gives no rows.
    Other columns are ignored.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score of THRESHOLD or more, columns as they are. The score's column has a name that docs lacks."""
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    return score(docs, fit(docs, labels), name).filter(F.col(name) >= THRESHOLD).drop(name)


def op6_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
