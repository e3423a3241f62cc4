"""Extra columns of any name pass through the stages and change nothing."""

import pytest

import corpus_pipeline

EXTRA = ("n", "fp", "sig", "node", "key", "row", "sha", "norm", "words", "spans", "host", "vote", "bucket_", "maybe_", "a.b", "hash_", "declared", "least")


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "packing"], ids=lambda s: s[0])
def test_extra_columns(spark, stage):
    rows = [(1, "the cat sat on the mat and it ran a.b@c.de", "en", "s", 5), (2, "the cat sat on the mat and it ran a.b@c.de", "en", "s", 5), (3, "le chat et la souris sont ici", "fr", None, 6)]
    docs = spark.createDataFrame([(*r, *[f"{r[0]}{c}" for c in EXTRA]) for r in rows], ["doc_id", "text", "lang", "source", "n_chars", *EXTRA])
    plain = {r.doc_id: (r.text, r.n_chars) for r in stage[1](spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), "").collect()}
    found = stage[1](spark, docs, "")
    assert found.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in found.collect()} == plain
    for r in found.collect():
        assert all(r[c] == f"{r.doc_id}{c}" for c in EXTRA)
