from __future__ import annotations

import hashlib

import corpus_pipeline
from treeline.llm.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


def test_stages_follow_one_another_and_keep_the_columns(spark, tmp_path):
    docs = first = spark.read.parquet(f"{D}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, D).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.schema.names == first.schema.names and docs.dtypes == first.dtypes
    assert 0.6 * first.count() < sizes[0] < first.count() and sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[4] == sizes[3]
    assert sorted(map(repr, corpus_pipeline.run(spark, D).collect())) == sorted(map(repr, docs.collect()))


def test_stages_stand_odd_rows(spark, docs, nothing):
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, nothing):
            out = stage(spark, table, D)
            assert out.count() <= 3 * table.count() + 6
            assert name == "tokens" or out.columns == table.columns


def test_the_last_stage_decodes_its_ids(spark, docs):
    sha = lambda text: hashlib.sha256((text or "").encode()).hexdigest()
    got = [(r.doc_id, r.decoded_sha256) for r in corpus_pipeline.token_ids(spark, docs, D).collect()]
    assert sorted(map(repr, got)) == sorted(repr((r.doc_id, sha(r.text))) for r in docs.collect())


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
