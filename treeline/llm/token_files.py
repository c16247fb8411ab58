"""Token ids in binary files.

Ids are replaced by their ranks in the corpus (most frequent first), and ranks written in one to four bytes each; a separate
stream of control bytes holds four lengths of two bits each. A block holds whole documents, each with a control stream of
its own that starts at a byte. Blocks are rows of Parquet files (so that Spark's committer handles retries and any file
system will do), beside a table of ranks. Reading turns control bytes into lengths by table lookup in numpy.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, byte_hashes, even_numbers, partitions, slices, table
from .segments import GAP, Memory, binaries, buffers, classes, per_text, runs

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK = 1 << 18
#: Documents that the provisional ranks come from. They only shorten intermediate files; the final ranks count all documents.
PROVISIONAL_DOCS = 500

_LENGTHS = (1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)).astype(np.uint8)


def pack(values: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, data bytes, and their bounds, of documents whose 32-bit values lie between bounds (all: one document)."""
    bounds = np.array([0, len(values)]) if bounds is None else bounds
    v = np.ascontiguousarray(values, "<u4")
    more = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    counts = np.diff(bounds)
    control_bounds = np.concatenate([[0], np.cumsum(-(-counts // 4))])
    padded = np.zeros(4 * control_bounds[-1], np.uint8)
    padded[np.arange(len(v)) + np.repeat(4 * control_bounds[:-1] - bounds[:-1], counts)] = more
    quads = padded.reshape(-1, 4)
    control = (quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6).astype(np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    ends = np.concatenate([[0], np.cumsum(more.astype(np.int64) + 1)])
    return control, data, control_bounds, ends[bounds]


def unpack(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The values of documents with so many values each, whose streams follow one another."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    used = -(-counts // 4) * 4
    if (used != counts).any():
        keep = np.ones(len(lengths), bool)
        pad = used - counts
        ends = np.cumsum(used)
        for k in (1, 2, 3):
            keep[ends[pad >= k] - k] = False
        lengths = lengths[keep]
    lengths = lengths.astype(np.int64)
    at = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        long = np.flatnonzero(lengths > k)
        out[long] |= raw[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: What the tokenizer does before it merges, as far as runs can be encoded one by one. Fixed values, as its file has them.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _cut_by_class(tokenizer) -> bool:
    known = json.loads(tokenizer.to_str())
    steps = (known.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    split = steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    bytewise = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    return bool((known.get("normalizer") or {}).get("normalizers") == NORMALIZERS and split and bytewise and not known["model"].get("dropout"))


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A tokenizer with other steps before its merges than those named above encodes whole texts. One with these makes any white space one space and drops it between words, and cuts words where letters, digits and marks
    meet; so a text's ids are those of such runs one after another (of whole words where a word holds other bytes than
    those known to behave so), and each distinct run is encoded once as long as it is remembered. New runs go to the library
    many at a time, with a control character between them that has an id of its own.
    """

    MARK = "\x01"

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        self.by_runs = _cut_by_class(self.inner)
        self.mark = self._ids(self.MARK)
        self.memory = Memory(self._learn)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.inner.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, raw: list[bytes]) -> list[np.ndarray]:
        words, out = [x.decode() for x in raw], []
        for lo in range(0, len(words), 256):
            part = words[lo : lo + 256]
            if len(self.mark) == 1 and not any(self.MARK in w for w in part):
                ids = self._ids(f" {self.MARK} ".join(part))
                cuts = np.flatnonzero(ids == self.mark[0]).tolist()
                if len(cuts) == len(part) - 1:
                    out.extend(ids[a:b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)]))
                    continue
            out.extend(map(self._ids, part))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their bounds."""
        if not self.by_runs:
            parts = [np.array(e.ids, np.uint32) for e in self.inner.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([0, *map(len, parts)])
        data, offsets = buffers(texts)
        found = classes(data, offsets)
        start = runs(found, offsets)
        end = np.append(start[1:], len(data))
        word = found[start] != GAP
        start, end = start[word], end[word]
        ids, size = self.memory.lookup(byte_hashes(data, start, end), data, start, end)
        return ids, per_text(size, start, offsets)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


BLOCKS = "shard int, block long, shard_start long, doc_ids array<long>, counts array<int>, n_tokens long, control binary, data binary"


def inverse(by_rank: np.ndarray) -> np.ndarray:
    out = np.zeros(int(by_rank.max()) + 1, np.uint32)
    out[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    return out


def frequencies(blocks: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """id, n over all blocks: each task adds up its own, one row per id of the vocabulary at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(by_rank), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                total += np.bincount(unpack(row["control"], row["data"], np.array(row["counts"], np.int64)), minlength=len(total))
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(by_rank[used].astype(np.int64)), pa.array(total[used])], ["id", "n"])

    return blocks.select("counts", "control", "data").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, scratch: Scratch, path: str, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """Writes all documents' ids in ascending order of doc_id; gives the files' blocks and ranks, as read back.

    Documents are encoded once, into blocks by provisional ranks; all ids in these are counted, and blocks written anew by the
    final ranks. Shards are ranges of doc_id of about as many documents each; a shard's blocks follow one another. A null text
    is empty (its end id alone); a null doc_id comes after all others; rows of one doc_id come in the order of their texts' hash. A
    text of any length is one document of one block. Other columns are ignored; an empty table gives no blocks.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sample = docs.select(F.substring("text", 1, 4000).alias("text")).limit(PROVISIONAL_DOCS).collect()
    seen = np.bincount(encoder(path).encode(pa.array([r.text for r in sample], pa.string()))[0], minlength=max(encoder(path).inner.get_vocab_size(), end_id + 1))
    provisional = np.argsort(-seen, kind="stable").astype(np.uint32)
    n = partitions(spark)
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10000).alias("cuts")).first().cuts or []
    cuts = np.array(sorted(set(cuts)), np.int64)
    places = np.array(even_numbers(spark, n, n), np.int32)  # a partition for each shard

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = inverse(provisional)
        for batch in slices(batches, most=1 << 20):
            ids, bounds = encoder(path).encode(batch.column("text"))
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            control, data, control_bounds, data_bounds = pack(rank_of[ids], bounds)
            doc = batch.column("doc_id")
            shard = np.searchsorted(cuts, np.asarray(pc.fill_null(doc, NULL_ID)), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places[shard]), pa.array(shard), doc, batch.column("tie"), pa.array(np.diff(bounds).astype(np.int32)), binaries(control, control_bounds), binaries(data, data_bounds)],
                ["place", "shard", "doc_id", "tie", "n", "control", "data"],
            )

    docs = docs.withColumn("tie", F.xxhash64("text"))
    coded = docs.mapInArrow(encode, "place int, shard int, doc_id long, tie long, n int, control binary, data binary")
    coded = coded.repartition(n, "place").sortWithinPartitions(F.col("shard"), F.col("doc_id").asc_nulls_last(), F.col("tie")).drop("place", "tie")
    first, first_path = scratch.write(coded.mapInArrow(join_blocks, BLOCKS))
    scratch.free()
    counted = frequencies(first, provisional).orderBy(F.desc("n"), "id").select("id").collect()  # at most the vocabulary
    by_rank = np.array([r.id for r in counted] or [end_id], np.uint32)
    ranks = scratch.keep(spark.createDataFrame(list(enumerate(map(int, by_rank))), "rank int, id int").coalesce(1))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = inverse(by_rank)[np.minimum(provisional, by_rank.max())]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                counts = np.array(row.column("counts")[0].as_py(), np.int64)
                values = rank_of[unpack(row.column("control")[0].as_py(), row.column("data")[0].as_py(), counts)]
                control, data, _, _ = pack(values, np.concatenate([[0], np.cumsum(counts)]))
                new = {"control": control.tobytes(), "data": data.tobytes()}
                yield pa.RecordBatch.from_arrays([pa.array([new[k]], pa.binary()) if k in new else row.column(k) for k in row.schema.names], row.schema.names)

    blocks = scratch.keep(first.mapInArrow(again, BLOCKS))
    scratch.drop(first_path)
    return blocks, ranks


def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order to blocks of BLOCK ids or a document more."""
    held: list[list] = [[], [], [], []]
    shard, block, start, size = -1, 0, 0, 0

    def flush() -> pa.RecordBatch:
        nonlocal held, block, start, size
        row = [[shard], [block], [start], [held[0]], [held[1]], [size], [b"".join(held[2])], [b"".join(held[3])]]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
        out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["shard", "block", "shard_start", "doc_ids", "counts", "n_tokens", "control", "data"])
        held, block, start, size = [[], [], [], []], block + 1, start + size, 0
        return out

    for batch in batches:
        for s, d, c, x, y in zip(*(batch.column(k).to_pylist() for k in ("shard", "doc_id", "n", "control", "data"))):
            if s != shard:
                if size:
                    yield flush()
                shard, block, start = s, 0, 0
            for h, v in zip(held, (d, c, x, y)):
                h.append(v)
            size += c
            if size >= BLOCK:
                yield flush()
    if size:
        yield flush()


def read(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian 32-bit) of every document in the files."""
    by_rank = np.array([r.id for r in ranks.orderBy("rank").collect()], np.uint32)
    sizes = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}  # a row per shard
    shard_at, total = {}, 0
    for s in sorted(sizes):
        shard_at[s], total = total, total + sizes[s]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                ids = by_rank[unpack(row["control"], row["data"], counts)].astype("<u4").tobytes()
                ends = np.cumsum(counts)
                starts = ends - counts
                parts = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["shard_start"] + shard_at[row["shard"]]), pa.array(counts), pa.array(parts, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def digest(read_back: DataFrame) -> DataFrame:
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_token_files(spark, sf_dir, tokenizer: str | None = None):
    import public_tokenizers

    path = tokenizer or public_tokenizers.path(TOKENIZER)
    blocks, ranks = write(table(spark, sf_dir, "documents"), Scratch(spark), path)
    return digest(read(blocks, ranks))
