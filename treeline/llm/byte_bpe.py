"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is what BPE makes of its bytes exactly if each pair of neighbours is what BPE makes of the pair's bytes
alone. So the last token of every prefix follows from the last tokens of shorter prefixes, and reading bytes left to right
is a nondeterministic transducer: a branch for each place where a token may begin that the bytes to come may still complete.
States of the deterministic machine are the last token that all branches share and the bytes after it; tokens are put out
when all branches share them, which takes as many bytes of lookahead as branches stay apart. States and transitions
are made when first needed.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_hashes, prepare, remembered, slices, table
from .segments import CLASS, GAP, ODD, Memory, binaries, buffers, classes, per_text, runs

RANKS = "byte_bpe_50k.tiktoken"
#: The pattern whose matches are runs of classes. Fixed value.
CUT_BY_CLASS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of what a worker remembers; beyond one, that memory starts anew.
STATES, PAIRS = 30_000, 150_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Turns bytes into token ids. State 0 begins a piece.

    Besides the states there are nodes, one for each longest end of what was read that some token begins with or is: a node knows
    the tokens that end there and the ends that a longer token may begin with. Where a state has no step yet for a byte, the
    rest of the piece is read with the branches as they are (first time), or the step is made (from the second time on), so
    that rare pieces make no states.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.shift = max(ranks.values(), default=0).bit_length() + 1
        self.open = {t[:n] for t in ranks for n in range(len(t))}  # what a longer token may begin with; "" is one
        self.pairs: dict[int, bool] = {}
        self.node_of: dict[bytes, int] = {}
        self.node_text: list[bytes] = []
        self.node_next: list[dict[int, int]] = []
        self.node_tokens: list[tuple[tuple[int, int], ...]] = []  # (length, id) of tokens that end here, longest first
        self.node_open: list[tuple[int, ...]] = []  # lengths of ends that a longer token may begin with
        self._node(b"")
        self._restart()

    def _restart(self) -> None:
        self.keys: list[tuple[int, bytes]] = [(-1, b"")]
        self.ids: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.steps: list[dict[int, tuple[int, tuple[int, ...]] | None]] = [{}]
        self.ends: list[tuple[int, ...] | None] = [()]
        self.nodes: list[int] = [0]
        self.branches: list[dict[int, tuple[int, int]]] = [{}]  # end in the pending bytes -> length and id of the last token there

    def _node(self, text: bytes) -> int:
        found = self.node_of.get(text)
        if found is None:
            found = self.node_of[text] = len(self.node_text)
            self.node_text.append(text)
            self.node_next.append({})
            ends = [text[i:] for i in range(len(text))]
            self.node_tokens.append(tuple((len(e), self.ranks[e]) for e in ends if e in self.ranks))
            self.node_open.append(tuple(len(e) for e in [*ends, b""] if e in self.open))
        return found

    def _goto(self, node: int, byte: int) -> int:
        text = self.node_text[node] + bytes((byte,))
        while text not in self.open and text not in self.ranks:
            text = text[1:]
        found = self.node_next[node][byte] = self._node(text)
        return found

    def merged(self, piece: bytes) -> list[int]:
        """BPE by its definition: merge the pair of lowest rank, leftmost first, until no pair has one."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _follows(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens as neighbours (left -1: whether it makes right of its bytes)."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        before = b"" if left < 0 else self.bytes_of[left]
        found = self.merged(before + self.bytes_of[right]) == ([right] if left < 0 else [left, right])
        self.pairs[left << self.shift | right] = found
        return found

    def _last(self, first: int, last: dict[int, tuple[int, int]], node: int, n: int) -> tuple[int, int]:
        """Length and id of the token that ends the first n pending bytes."""
        pairs, shift = self.pairs, self.shift
        for length, token in self.node_tokens[node]:
            start = n - length
            if start > 0:
                found = last.get(start)
                if found is None:
                    continue
                before = found[1]
            elif start:
                continue
            else:
                before = first
            good = pairs.get(before << shift | token)
            if good is None:
                good = self._follows(before, token)
            if good:
                return length, token
        raise ValueError("these ranks lack a token for some byte, or hold one that merges cannot make")

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        first, pending = self.keys[state]
        node = self.node_next[self.nodes[state]].get(byte)
        if node is None:
            node = self._goto(self.nodes[state], byte)
        pending += bytes((byte,))
        n = len(pending)
        ends = dict(self.branches[state])
        ends[n] = self._last(first, ends, node, n)
        heads = {p for p in (n - k for k in self.node_open[node]) if p in ends or not p}
        alive = set()
        while len(heads) > 1:  # step back from the farthest branch until all have met
            p = max(heads)
            heads.discard(p)
            alive.add(p)
            heads.add(p - ends[p][0])
        cut = at = heads.pop()
        out = []
        while at:
            length, token = ends[at]
            out.append(token)
            at -= length
        out.reverse()
        key = (out[-1] if out else first, pending[cut:])
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.steps.append({})
            self.ends.append(None)
            # the node of the pending bytes alone: an end that reaches over the cut begins no token to come
            text = self.node_text[node]
            self.nodes.append(node if len(text) <= n - cut else self._inner(pending[cut:]))
            self.branches.append({p - cut: ends[p] for p in alive})
        done = self.steps[state][byte] = (found, tuple(out))
        return done

    def _inner(self, text: bytes) -> int:
        while text not in self.open and text not in self.ranks:
            text = text[1:]
        return self._node(text)

    def _end(self, state: int) -> tuple[int, ...]:
        last = self.branches[state]
        out, at = [], len(self.keys[state][1])
        while at:
            length, token = last[at]
            out.append(token)
            at -= length
        self.ends[state] = done = tuple(reversed(out))
        return done

    def _read_on(self, state: int, rest: bytes) -> list[int]:
        """The ids of what is pending in a state and of the bytes after it, without making states."""
        first, pending = self.keys[state]
        last, node, n = dict(self.branches[state]), self.nodes[state], len(pending)
        for byte in rest:
            to = self.node_next[node].get(byte)
            node = self._goto(node, byte) if to is None else to
            n += 1
            last[n] = self._last(first, last, node, n)
        out = []
        while n:
            length, token = last[n]
            out.append(token)
            n -= length
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece. A piece that is a token as it stands is that token, as tiktoken has it."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.keys) > STATES:
            self._restart()
        state, out, steps = 0, [], self.steps
        for i, byte in enumerate(piece):
            step = steps[state].get(byte)
            if step is None:
                if byte not in steps[state] and len(piece) - i < 256:
                    steps[state][byte] = None
                    out.extend(self._read_on(state, piece[i:]))
                    return out
                step = self._step(state, byte)
            state = step[0]
            if step[1]:
                out.extend(step[1])
        end = self.ends[state]
        out.extend(self._end(state) if end is None else end)
        return out


class Codec:
    """Whole texts to ids, each match of the pattern by itself, and back.

    Where a text's bytes are ASCII or letters from U+00C0 to U+00FF, the pattern's matches are runs of letters, of digits or of
    marks, each with the space before it, and white space: these are cut by class of bytes. Runs between white space that
    hold other bytes or an apostrophe go through the pattern whole, with the space before; texts that may hold white space
    beyond ASCII go through it altogether. A run's ids are remembered. With another pattern than CUT_BY_CLASS all texts go through it
    whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.machine, self.split, self.by_runs = Transducer(ranks), regex.compile(pattern).findall, pattern == CUT_BY_CLASS
        self.memory = Memory(lambda raw: [self._run(x) for x in raw])
        self.table = [self.machine.bytes_of.get(i, b"") for i in range(max(self.machine.bytes_of, default=0) + 1)]
        self.lengths = np.array([len(t) for t in self.table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.table), np.uint8)
        self.whole = np.array([_is_text(t) for t in self.table])

    def _run(self, raw: bytes) -> np.ndarray:
        if CLASS[np.frombuffer(raw, np.uint8)].max() < ODD:
            return np.array(self.machine.encode(raw), np.uint32)
        return self._pattern(raw.decode())

    def _pattern(self, text: str) -> np.ndarray:
        return np.array([i for piece in self.split(text) for i in self.machine.encode(piece.encode())], np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their bounds."""
        if not self.by_runs:
            parts = [self._pattern(x or "") for x in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([0, *map(len, parts)])
        data, offsets = buffers(texts)
        n = len(data)
        found = classes(data, offsets)
        start = runs(found, offsets)
        end = np.append(start[1:], n)
        gap = found[start] == GAP
        begins = np.zeros(n + 1, bool)
        begins[offsets[:-1]] = True
        begins[n] = True
        # the last white space before a run is the run's if it is a space, else a match of its own; what is before it is another
        g = np.flatnonzero(gap)
        last_of_text = begins[end[g]]
        g_end, tail = end[g], end[g] - 1
        space = ~last_of_text & (data[tail] == 0x20)
        alone = ~last_of_text & ~space
        cut = np.where(last_of_text, g_end, tail)
        rest = cut > start[g]
        after = np.zeros(n + 1, bool)
        after[g_end[space]] = True
        r = np.flatnonzero(~gap)
        r_start = start[r] - after[start[r]]
        starts = np.concatenate([r_start, start[g][rest], tail[alone]])
        ends = np.concatenate([end[r], cut[rest], g_end[alone]])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        odd = self._maybe_wide(data, offsets)
        if odd.any():
            keep = ~odd[np.searchsorted(offsets, starts, "right") - 1] if len(starts) else np.zeros(0, bool)
            starts, ends = starts[keep], ends[keep]
        ids, size = self.memory.lookup(byte_hashes(data, starts, ends), data, starts, ends)
        bounds = per_text(size, starts, offsets)
        if odd.any():
            raw = data.tobytes()
            parts = [self._pattern(raw[offsets[i] : offsets[i + 1]].decode()) if odd[i] else ids[bounds[i] : bounds[i + 1]] for i in range(len(odd))]
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bounds

    @staticmethod
    def _maybe_wide(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts with a byte that white space beyond ASCII begins with."""
        sums = np.concatenate([[0], np.cumsum(_WIDE_SPACE[data])])
        return sums[offsets[1:]] > sums[offsets[:-1]]

    def bytes_for(self, ids: np.ndarray) -> bytes:
        size = self.lengths[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.starts[ids] - (ends - size), size) + np.arange(total)].tobytes()


#: First bytes of U+0085, U+00A0, U+1680, U+2000 to U+205F and U+3000.
_WIDE_SPACE = np.zeros(256, bool)
_WIDE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _utf8_states() -> np.ndarray:
    """next[state][byte] of the automaton of valid UTF-8; state 0: between characters, -1: no character."""
    names = {"start": 0, "one": 1, "two": 2, "three": 3, "after_e0": 4, "after_ed": 5, "after_f0": 6, "after_f4": 7}
    step = np.full((8, 256), -1, np.int8)
    step[0, :0x80] = 0
    step[0, 0xC2:0xE0] = names["one"]
    step[0, 0xE1:0xF0] = names["two"]
    step[0, 0xE0], step[0, 0xED] = names["after_e0"], names["after_ed"]
    step[0, 0xF1:0xF4] = names["three"]
    step[0, 0xF0], step[0, 0xF4] = names["after_f0"], names["after_f4"]
    for name, lo, hi, to in (("one", 0x80, 0xC0, "start"), ("two", 0x80, 0xC0, "one"), ("three", 0x80, 0xC0, "two"), ("after_e0", 0xA0, 0xC0, "one"), ("after_ed", 0x80, 0xA0, "one"), ("after_f0", 0x90, 0xC0, "two"), ("after_f4", 0x80, 0x90, "two")):
        step[names[name], lo:hi] = names[to]
    return step


class StreamDecoder:
    """Text of a stream of ids that comes in parts: a part's text ends with its last whole character, and the bytes of a begun
    one wait for the next part. Bytes that can't belong to a character become U+FFFD."""

    _next = _utf8_states().tolist()

    def __init__(self, own: Codec) -> None:
        self.own, self.state, self.held = own, 0, b""

    def feed(self, ids: np.ndarray) -> str:
        own = self.own
        broken = np.flatnonzero(~own.whole[ids])
        if not self.state and not len(broken):
            return own.bytes_for(ids).decode()
        out, at, k = [], 0, 0
        while at < len(ids):
            if not self.state:  # up to the next token that isn't whole characters
                k = int(np.searchsorted(broken, at))
                stop = int(broken[k]) if k < len(broken) else len(ids)
                out.append(own.bytes_for(ids[at:stop]).decode())
                at = stop
                if at == len(ids):
                    break
            self._read(own.table[ids[at]], out)
            at += 1
        return "".join(out)

    def _read(self, part: bytes, out: list[str]) -> None:
        step = self._next
        for byte in part:
            to = step[self.state][byte]
            if to < 0 and self.state:  # what was begun is no character; the byte may begin one
                out.append("\ufffd")
                self.held, self.state = b"", 0
                to = step[0][byte]
            if to < 0:
                out.append("\ufffd")
                continue
            self.held += bytes((byte,))
            self.state = to
            if not to:
                out.append(self.held.decode())
                self.held = b""

    def close(self) -> str:
        left, self.held, self.state = self.held, b"", 0
        return "\ufffd" if left else ""


_codecs: dict[tuple[str, str], Codec] = remembered()


def codec(path: str, pattern: str) -> Codec:
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(load_ranks(path), pattern)
    return _codecs[key]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit). A null text is empty and has no ids; a null doc_id stays
    null; repeated rows stay repeated; other columns are left out; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, most=1 << 20):
            ids, bounds = own.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), binaries(ids.astype("<u4"), bounds)], ["doc_id", "n_tokens", "ids"])

    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids of encode() -> doc_id, text, as the stream decoder has it. No ids give an empty text, null ids a null one;
    null doc_ids and repeated rows stay; other columns are left out; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [None if x is None else decoded(own, np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    prepare(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids of encode() and decoded_sha256 of the text that the ids give back, in one pass, so that a task has one worker
    with one codec. Nulls, repeats and empty tables as in encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, most=1 << 20):
            ids, bounds = own.encode(batch.column("text"))
            ids = np.ascontiguousarray(ids, "<u4")
            back = [hashlib.sha256(decoded(own, ids[a:b]).encode()).hexdigest() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), binaries(ids, bounds), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded_sha256 string")


def decoded(own: Codec, ids: np.ndarray) -> str:
    stream = StreamDecoder(own)
    return stream.feed(ids) + stream.close()


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts; nulls and repeats as in encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, most=1 << 20):
            ids, bounds = own.encode(batch.column("text"))
            ids = np.ascontiguousarray(ids, "<u4")
            parts = [ids[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            sha = [hashlib.sha256(x).hexdigest() for x in parts]
            back = [hashlib.sha256(decoded(own, x).encode()).hexdigest() for x in parts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark, sf_dir, ranks: str | None = None):
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), ranks or public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
