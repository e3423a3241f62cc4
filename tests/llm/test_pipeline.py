import os
from collections import defaultdict

import pytest
from oracle import compare
from test_exact_dedup import plain
from test_pii import slow_base
from test_simhash import slow_near

import corpus_pipeline
from kinfold.llm import language, pii, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_its_sql(spark, name):
    compare(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "12 34", "en", "s", 5), (10**6 + 1, None, None, None, None), (10**6 + 2, "", "", "", 0)], docs.schema)
    docs, columns, kept = docs.unionByName(extra), docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert sorted(after.columns) == sorted(columns)
        if name == "language_id":
            told = {r.doc_id for r in language.identify(docs).collect() if r.accepted}
            assert {r.doc_id for r in after.collect()} == told and not told & {10**6, 10**6 + 1, 10**6 + 2}
        elif name == "exact_dedup":
            assert {r.doc_id for r in after.collect()} == {k for k, _, _ in plain(list(before.items())).values()}
        elif name == "simhash_dedup":
            ids = sorted(before)
            roots = slow_near([before[i] for i in ids])
            assert {r.doc_id for r in after.collect()} == {ids[i] for i in set(roots)}
        elif name == "pii":
            rows = after.collect()
            assert {r.doc_id for r in rows} == set(before)
            for r in rows:
                assert slow_base(r.text) == [] and r.n_chars == len(r.text)
                if not slow_base(before[r.doc_id]):
                    assert r.text == before[r.doc_id]
        else:
            words = defaultdict(int)
            for r in after.collect():
                words[r.doc_id] += r.n_words
            assert words == {i: len(t.split()) for i, t in before.items()}
        docs = after
        kept[name] = after.count()
    assert 0 < kept["simhash_dedup"] <= kept["exact_dedup"] <= kept["language_id"]
    assert pii.KINDS == ("email", "ip", "card", "phone")


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
