import hashlib
import random
from collections import defaultdict

import numpy as np

from kinfold.llm import exact_dedup
from kinfold.llm.exact_dedup import CountingQuotientFilter as Filter


def test_filters_merge_losslessly_and_survive_bytes():
    rng = np.random.default_rng(1)
    for bits in (0, 6, 9):
        pool = rng.integers(0, 2**63, 500, dtype=np.uint64) >> np.uint64(bits)
        pool |= np.uint64(5 << (64 - bits)) if bits else np.uint64(0)
        parts = [rng.choice(pool, n) for n in (0, 1, 50, 2000)]
        merged = Filter.build(5 if bits else 0, bits, parts[0])
        for part in parts[1:]:
            one = Filter.build(merged.prefix, bits, part)
            merged = merged.merge(Filter.from_bytes(one.prefix, bits, one.to_bytes()))
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        again = Filter.from_bytes(merged.prefix, bits, merged.to_bytes())
        assert (again.values == values).all() and (again.counts == counts).all()


def plain(rows):
    groups = defaultdict(list)
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\f\r")
    for i, text in rows:
        groups[norm(text)].append((-len(text or ""), i))
    return {i: (min(groups[norm(t)])[1], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}


def test_against_plain_grouping(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a b", "ab", " a\tb ", "é x", "é x", None, "", " \n", "hot copy" * 99, "one" + str(i)])) for i in range(500)]
    docs = spark.createDataFrame([r + ("u", 1) for r in rows], "doc_id long, text string, sha string, row int")
    found = exact_dedup.exact_dedup(docs).collect()
    want = plain(rows)
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in found} == want
    assert {r.doc_id for r in found if r.kept} == {k for k, _, _ in want.values()}
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, _, _ in want.values()}


def test_repeated_rows_null_ids_and_empty(spark):
    schema = "doc_id long, text string"
    found = exact_dedup.exact_dedup(spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (None, "y")], schema)).collect()
    assert sum(r.kept for r in found if r.text_sha256 == found[0].text_sha256) >= 1
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in found) == [("1", "1", 3), ("1", "1", 3), ("None", "1", 3), ("None", "None", 1)]
    assert sum(r.kept for r in found) == 2
    assert exact_dedup.exact_dedup(spark.createDataFrame([], schema)).collect() == []


def test_filter_bytes_are_in_proportion():
    rng = np.random.default_rng(3)
    for n in (1, 6, 100, 5000):
        one = Filter.build(0, 6, rng.integers(0, 2**57, n, dtype=np.uint64))
        assert len(one.to_bytes()) <= 24 + 9.5 * n


def test_very_long_texts(spark):
    rows = [(1, "ab " * 300_000), (2, "a b" * 300_000), (3, "ab " * 299_999)]
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in found} == {1: (1, 2), 2: (1, 2), 3: (3, 1)}
