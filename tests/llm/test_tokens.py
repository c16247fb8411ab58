from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from treeline.llm import byte_bpe, token_files
from treeline.llm.common import Scratch, Words

tokenizers = pytest.importorskip("public_tokenizers")
WORD, RANKS = tokenizers.path(token_files.TOKENIZER), tokenizers.path(byte_bpe.RANKS)
PIECES = ["the", "ing", " ", "a", "é", "ç", "×", "Ÿ", "日", "\U0001f600", "12", "  ", "\n", "!!", "%%%", "\x00", "İ", "'s", "'", "\xa0", "　", "\x1c", "\x85", "́", "\x01", "²", "\r\n", "\t"]


def texts(seed, n):
    rng = random.Random(seed)
    return [None, "", *("".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(n))]


def test_words_of_batches_and_long_texts(monkeypatch):
    from tests.llm.conftest import WORDS
    from treeline.llm import common

    monkeypatch.setattr(common, "_SLICE", 16)
    given = texts(1, 200) + ["x" * 100, "ab " * 50]
    w = Words(pa.array(given, pa.string()))
    for i, t in enumerate(given):
        found = [bytes(w.data[a:b]).decode() for a, b in zip(w.start[w.bounds[i] : w.bounds[i + 1]], w.end[w.bounds[i] : w.bounds[i + 1]])]
        assert found == WORDS.findall(t or "")


def test_word_tokenizer_equals_the_library():
    e = token_files.Encoder(WORD)
    given = texts(2, 400)
    ids, bounds = e.encode(pa.array(given, pa.string()))
    for i, t in enumerate(given):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == e.inner.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_byte_bpe_equals_tiktoken_and_decodes_from_any_cut():
    import tiktoken

    ranks = byte_bpe.load_ranks(RANKS)
    own, lib = byte_bpe.Codec(ranks, tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    given = texts(3, 400) + ["".join(random.Random(4).choice("abcdefgh") for _ in range(3000))]
    ids, bounds = own.encode(pa.array(given, pa.string()))
    for i, t in enumerate(given):
        x = ids[bounds[i] : bounds[i + 1]]
        assert x.tolist() == lib.encode_ordinary(t or ""), repr(t)
        stream = byte_bpe.StreamDecoder(own)
        assert "".join(stream.feed(x[j : j + 1]) for j in range(len(x))) + stream.close() == (t or "")


def test_stream_decoder_replaces_what_is_no_text():
    ranks = byte_bpe.load_ranks(RANKS)
    own = byte_bpe.Codec(ranks, tokenizers.PATTERN)
    stream = byte_bpe.StreamDecoder(own)
    assert stream.feed(np.array([ranks[b] for b in (b"\xe6", b"\x97", b"a", b"\xff", b"\xe6")])) + stream.close() == "�a��"


def test_states_start_anew(monkeypatch):
    monkeypatch.setattr(byte_bpe, "STATES", 20)
    monkeypatch.setattr(byte_bpe, "PAIRS", 20)
    ranks = byte_bpe.load_ranks(RANKS)
    t = byte_bpe.Transducer(ranks)
    rng = random.Random(5)
    for _ in range(300):
        piece = bytes(rng.choice(b"therainstou") for _ in range(rng.randrange(1, 20)))
        assert t.encode(piece) == ([ranks[piece]] if piece in ranks else t.merged(piece))


def test_packing_round_trip():
    v = np.random.default_rng(0).choice([3, 300, 70_000, 2**25], 1000).astype(np.uint32)
    bounds = np.array([0, 0, 5, 17, 1000])
    control, data, _, _ = token_files.pack(v, bounds)
    assert (token_files.unpack(control.tobytes(), data.tobytes(), np.diff(bounds)) == v).all()


@pytest.mark.parametrize("table", ["docs", "plain", "nothing"])
def test_token_files_hold_every_document_in_order(request, table, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 200)
    df = request.getfixturevalue(table)
    blocks, ranks = token_files.write(df, Scratch(df.sparkSession), WORD)
    e = token_files.Encoder(WORD)
    want = sorted(((r.doc_id is None, r.doc_id or 0), np.array([*e.inner.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in df.collect())
    rows = sorted(token_files.read(blocks, ranks).collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id is None, r.doc_id or 0), bytes(r.ids)) for r in rows) == want
    assert [(r.doc_id is None, r.doc_id or 0) for r in rows] == [k for k, _ in want]
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    got = {(d.start, d.ids_crc32) for d in token_files.digest(token_files.read(blocks, ranks)).collect()}
    assert got == {(r.start, zlib.crc32(r.ids)) for r in rows}


@pytest.mark.parametrize("table", ["docs", "nothing"])
def test_round_trip(request, table):
    import hashlib

    df = request.getfixturevalue(table)
    want = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in df.collect())
    assert sorted(r.decoded_sha256 for r in byte_bpe.round_trip(df, RANKS, tokenizers.PATTERN).collect()) == want
    back = byte_bpe.decode(byte_bpe.encode(df, RANKS, tokenizers.PATTERN), RANKS, tokenizers.PATTERN)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, (r for r in df.na.fill("", ["text"]).select("doc_id", "text").collect())))
