"""Operators that SQL can express, against it in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from treeline.llm.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = c.execute(ORACLES[name])
    names = [x[0] for x in want.description]
    got = QUERIES[name](spark, D)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
