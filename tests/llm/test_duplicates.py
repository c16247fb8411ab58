from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import LOWER, WORDS
from treeline.llm import jaccard, neardup_vectors, substrings
from treeline.llm.common import Scratch, components

LAST = 1 << 63


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    want = roots(150, links)
    assert all(got[x] == want[x] for a, b in links if a != b for x in (a, b))


def test_lengths_double():
    assert substrings.lengths(13) == [7, 13] and substrings.lengths(50) == [7, 13, 25, 50] and substrings.lengths(5) == [5] and substrings.lengths(13, 2) == [2, 4, 7, 13]


@pytest.mark.parametrize("table,n,first,chunk", [("docs", 13, 6, 1 << 19), ("docs", 13, 2, 40), ("plain", 13, 6, 100), ("plain", 5, 2, 30), ("plain", 1, 1, 50), ("plain", 140, 6, 50), ("nothing", 13, 6, 50)])
def test_repeated_windows_go(request, table, n, first, chunk):
    df = request.getfixturevalue(table)
    rows = [(LAST if r.doc_id is None else r.doc_id, r.doc_id, WORDS.findall(r.text or "")) for r in df.collect()]
    least = {}
    for d, _, w in rows:
        for i in range(len(w) - n + 1):
            least[tuple(w[i : i + n])] = min(d, least.get(tuple(w[i : i + n]), LAST + 1))
    want = []
    for d, doc_id, w in rows:
        gone = set()
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        want.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = substrings.without_repeats(df, n, first, chunk)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_long_texts_and_passages_of_many_documents(spark):
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(160)]
    rows = []
    for i in range(120):
        own = [f"o{i}_{k}" for k in range(rng.randrange(40))]
        rows.append((i, " ".join(own + (passage if i % 3 == 0 else passage[: rng.randrange(160)]))))
    rows.append((500, " ".join(rng.choice("abc") for _ in range(60_000)) + " " + "x" * 100_000))
    rows.append((501, rows[-1][1][2:]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (13, 140):
        seen, want = {}, {}
        for d, t in rows:
            w = t.split()
            own, gone = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, set()
            for i in range(len(w) - n + 1):
                if seen.get(tuple(w[i : i + n]), d) < d:
                    gone.update(range(i, i + n))
            for x in own:
                seen.setdefault(x, d)
            want[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
        assert {r.doc_id: tuple(r)[1:] for r in substrings.without_repeats(df, n, chunk=4000).collect()} == want


def shingle_set(text, n):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


@pytest.mark.parametrize("table,n,percent", [("docs", 4, 85), ("plain", 4, 60), ("plain", 2, 30), ("plain", 5, 80), ("nothing", 4, 85)])
def test_jaccard_components(request, table, n, percent, monkeypatch):
    if percent == 30:
        monkeypatch.setattr(jaccard, "MAPPED", 3)
        monkeypatch.setattr(jaccard, "SKETCH", 1)
        monkeypatch.setattr(jaccard, "KEPT", 1)  # shingles agree by accident all the time
    df = request.getfixturevalue(table)
    rows = sorted(df.collect(), key=lambda r: LAST if r.doc_id is None else r.doc_id)
    sets = [shingle_set(r.text, n) for r in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = roots(len(rows), links)
    want = sorted(repr((r.doc_id, len(s), rows[k].doc_id)) for r, s, k in zip(rows, sets, root))
    assert sorted(repr(tuple(r)) for r in jaccard.join(df, n, percent).collect()) == want
    kept = jaccard.without_near_copies(df, n, percent)
    assert kept.columns == df.columns and kept.count() == sum(i == k for i, k in enumerate(root))


def test_accidents():
    assert jaccard.accidents(500, 500, 5) == 2 and jaccard.accidents(10**6, 10**6, 5) > 10 and jaccard.accidents(50, 50, 8) <= 1
    assert jaccard.accidents(40, 40, 1) > 6


@pytest.mark.parametrize("part", [1024, 20])
def test_large_group_of_near_copies(spark, monkeypatch, part):
    monkeypatch.setattr(jaccard, "PART", part)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(f"y{i}_{k}" for k in range(40)) + " " + " ".join(base[:20])) for i in range(150, 200)]
    out = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    sets = {i: shingle_set(t, 4) for i, t in rows}
    links = [(i, j) for i in sets for j in sets if j < i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert list(out[i] for i in sorted(out)) == roots(200, links)


def vectors(n=400, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 8, dim))
    rows = [base[i % len(base)] * rng.uniform(0.5, 2) + rng.normal(size=dim) * rng.choice([0.02, 0.12, 0.3]) for i in range(n)]
    rows += [rows[3], rows[3], rows[3]]
    return [(i * 5, [float(x) for x in v]) for i, v in enumerate(rows)]


ODD = [(100_001, None), (100_002, []), (100_003, [0.0] * 16), (100_004, [float("nan")] * 16), (100_006, [None] * 16), (100_007, [1.0, 0.0]), (100_008, [2.0, 0.0]), (None, [1.0, 0.5]), (0, [float("inf")] * 16)]


def test_near_vectors_against_brute_force(spark):
    rows = vectors() + ODD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("uid", F.lit("clash"))
    order = sorted(range(len(rows)), key=lambda i: LAST if rows[i][0] is None else rows[i][0])
    rows = [rows[i] for i in order]
    good = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = []
    for i in good:
        for j in good:
            if j < i and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1]), np.array(rows[j][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                    links.append((i, j))
    root, count = roots(len(rows), links), defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    got = neardup_vectors.near_duplicates(df).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got)
    assert 0.97 * 2 * len(links) <= found <= 2 * len(links)
    want = sorted(repr((rows[i][0], count[i], rows[root[i]][0])) for i in range(len(rows)))
    same = sum(a == b for a, b in zip(sorted(repr((r.vec_id, r.n_links, r.component_id)) for r in got), want))
    assert same >= 0.97 * len(want)


def groups_of(n: int, size: int, dim: int, noise: float, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    x = np.repeat(base, size, axis=0) + noise * rng.normal(size=(n * size, dim))
    return x[rng.permutation(len(x))]


def brute_links(x: np.ndarray) -> tuple[np.ndarray, list[int]]:
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    return near.sum(axis=1), roots(len(x), np.argwhere(np.triu(near)).tolist())


@pytest.mark.parametrize("n,size,noise,shard", [(40, 70, 0.25, 2048), (500, 9, 0.2, 600), (3, 900, 0.05, 400)])
def test_groups_of_near_copies(spark, monkeypatch, n, size, noise, shard):
    monkeypatch.setattr(neardup_vectors, "SHARD", shard)
    exact = []
    monkeypatch.setattr(neardup_vectors, "exact_links", lambda *a: exact.append(a))
    x = groups_of(n, size, 64, noise, n)
    count, root = brute_links(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in neardup_vectors.near_duplicates(df).collect()}
    assert not exact and count.sum() > 30_000
    assert all(got[i].n_links <= count[i] for i in got)
    assert np.mean([got[i].n_links / count[i] for i in got if count[i]]) >= 0.97 and sum(r.n_links for r in got.values()) >= 0.97 * count.sum()
    assert np.mean([got[i].component_id == root[i] for i in got]) >= 0.97
    size_of = defaultdict(int)
    for r in got.values():
        size_of[r.component_id] += 1
    assert all((r.n_links > 0) == (size_of[r.component_id] > 1) for r in got.values())


def test_a_shard_that_stays_large_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "LARGEST", 200)
    monkeypatch.setattr(neardup_vectors, "BLOCK", 90)
    x = groups_of(2, 300, 24, 0.1, 5)
    count, root = brute_links(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in neardup_vectors.near_duplicates(df).collect()} == {i: (c, r) for i, (c, r) in enumerate(zip(count.tolist(), root))}


def test_the_graph_is_connected_and_its_search_finds_whole_groups():
    x = groups_of(40, 70, 64, 0.25, 4)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges = neardup_vectors.pruned_edges(x.astype(np.float32))
    assert len(set(roots(len(x), edges.tolist()))) == 1 and len(edges) < 2.2 * neardup_vectors.DEGREE * len(x)
    starts = np.searchsorted(edges[:, 0], np.arange(len(x) + 1))
    found = np.concatenate(list(neardup_vectors.verified(x, neardup_vectors.searched(x, starts, edges[:, 1], 0.9), 0.9)))
    true = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    assert {*map(tuple, found.tolist())} <= {*map(tuple, true.tolist())} and len(found) >= 0.98 * len(true)


def test_links_that_no_overlap_finds_are_found_in_the_end(spark, monkeypatch):
    alone = lambda reps, n, overlap: reps.select("uid", "unit", "copies", F.col("uid").alias("shard"), F.array("uid").alias("shards"))
    monkeypatch.setattr(neardup_vectors, "placed", alone)
    monkeypatch.setattr(neardup_vectors, "BLOCK", 100)
    rows = vectors()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: r.n_links for r in neardup_vectors.near_duplicates(df).collect()} == {i: n for (i, _), n in zip(rows, want.tolist())}


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neardup_vectors.near_duplicates(df).collect()] == [(1, 0, 1, True)]
    assert neardup_vectors.near_duplicates(df.limit(0)).count() == 0
