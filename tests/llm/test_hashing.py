"""Texts that a sum of powers modulo 2**64 takes for one another, and hashes that are made to collide."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from treeline.llm import byte_bpe, jaccard, substrings, suffix_tree, token_files
from treeline.llm.common import Scratch, Words

tokenizers = pytest.importorskip("public_tokenizers")


def alternating(n: int, turned: bool = False) -> str:
    return "".join("ab"[(bin(i).count("1") + turned) % 2] for i in range(n))


PAIRS = [(alternating(n), alternating(n, True)) for n in (1024, 2048, 4096)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(2 * i + j, f"{w} tail of {i}") for i, pair in enumerate(PAIRS) for j, w in enumerate(pair)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_words_have_hashes_of_their_own():
    words = [w for pair in PAIRS for w in pair] + [str(i) * k for i in range(300) for k in (1, 3, 9, 80, 300)]
    words = sorted(set(words))
    assert len(set(Words(pa.array([" ".join(words)])).hash.tolist())) == len(words)
    one, other = Words(pa.array(["x" + " " + words[5]])), Words(pa.array([words[5]]))
    assert one.hash[1] == other.hash[0]


def test_token_files(table):
    df, rows = table
    path = tokenizers.path(token_files.TOKENIZER)
    lib = token_files.Encoder(path).inner
    want = {i: np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in rows}
    assert {r.doc_id: bytes(r.ids) for r in token_files.read(*token_files.write(df, Scratch(df.sparkSession), path)).collect()} == want


def test_byte_bpe(table):
    import tiktoken

    df, rows = table
    path = tokenizers.path(byte_bpe.RANKS)
    lib = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.round_trip(df, path, tokenizers.PATTERN).collect()}
    for i, t in rows:
        assert got[i].ids_sha256 == hashlib.sha256(np.array(lib.encode_ordinary(t), "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_windows_shingles_and_words(spark):
    same = " ".join(f"w{i}" for i in range(12))
    rows = [(2 * i + j, f"{w} {same}") for i, pair in enumerate(PAIRS) for j, w in enumerate(pair)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_removed == 0 for r in substrings.without_repeats(df).collect())
    short = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(rows) for w in [rows[i][1].split()[0]]], "doc_id long, text string")
    assert all(r.component_id == r.doc_id for r in jaccard.join(short).collect())
    got = suffix_tree.score(short).collect()
    held = {i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 7 == 2}
    assert {r.doc_id: r.n_known for r in got} == {i: 1 if i in held else 2 for i in range(len(rows))}


def test_memory_compares_bytes(monkeypatch):
    weak = lambda data, start, end: (end - start).astype(np.uint64) % np.uint64(3) + np.uint64(1)
    texts = ["the cat sat on the mat", "a dog ate the bone, and 12 more", "the dog sat", "word " * 5, "x" * 900 + " " + "y" * 900 + " " + "x" * 899 + "y"]
    path = tokenizers.path(token_files.TOKENIZER)
    e, c = token_files.Encoder(path), byte_bpe.Codec(byte_bpe.load_ranks(tokenizers.path(byte_bpe.RANKS)), tokenizers.PATTERN)
    want = [x.tolist() for own in (e, c) for x in own.encode(pa.array(texts))]
    for module in (token_files, byte_bpe):
        monkeypatch.setattr(module, "byte_hashes", weak)
    e, c = token_files.Encoder(path), byte_bpe.Codec(byte_bpe.load_ranks(tokenizers.path(byte_bpe.RANKS)), tokenizers.PATTERN)
    for _ in range(2):
        assert [x.tolist() for own in (e, c) for x in own.encode(pa.array(texts))] == want


def test_other_tokenizers_and_patterns_go_through_whole(tmp_path):
    import tiktoken

    texts = ["The CAT  sat,\n3 times 1234!", "", None, "naïve 'tis"]
    e = token_files.Encoder(tokenizers.path("byte_bpe_50k.json"))
    ids, bounds = e.encode(pa.array(texts))
    assert not e.by_runs and [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.inner.encode(t or "", add_special_tokens=False).ids for t in texts]
    ranks, pattern = byte_bpe.load_ranks(tokenizers.path(byte_bpe.RANKS)), r"\p{L}+|\P{L}"
    c = byte_bpe.Codec(ranks, pattern)
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    ids, bounds = c.encode(pa.array(texts))
    assert not c.by_runs and [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [lib.encode_ordinary(t or "") for t in texts]
