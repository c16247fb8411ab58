from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import WORDS
from treeline.llm import mixing


def shares(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        w = sum(weight[s] for s in names if s not in capped)
        over = [s for s in names if s not in capped and rest * weight[s] / w > 3 * sizes[s]]
        if not over:
            return {s: float(capped[s]) if s in capped else rest * weight[s] / w for s in names}
        capped.update({s: 3 * sizes[s] for s in over})


@pytest.mark.parametrize("table", ["docs", "plain"])
def test_targets_and_cuts(request, table):
    df = request.getfixturevalue(table)
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count()
    sizes = defaultdict(int)
    for r in df.collect():
        sizes[r.source] += len(WORDS.findall(r.text or ""))
    want, taken = shares(sizes), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in want)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_capped_source_and_empty_source(spark):
    rows = [(1, "a b", "b"), (2, None, "c"), (3, "w " * 100, "d"), (4, "q", "a")]
    out = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[2].target == 0 and out[2].taken == 0
    assert out[4].target == 3 and out[4].taken == 3 and out[1].target == 6


def test_mixed_documents_hold_the_words_taken(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = sum(len(WORDS.findall(r.text or "")) for r in out.collect())
    assert words == mixing.mix(docs).agg(F.sum("taken")).first()[0]
    originals = {r.text for r in docs.collect()}
    cut = [r.text for r in out.collect() if r.text not in originals]
    assert len(cut) <= docs.select("source").distinct().count()
    assert all(any(o and o.startswith(c) for o in originals) for c in cut)


def test_empty_table(nothing):
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
