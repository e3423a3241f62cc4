import random

import numpy as np
import pytest

from kinfold.llm import passages as P


def slow_windows(values, width):
    """All stretches of at least width, by the place of their leftmost minimum."""
    n, spans = len(values), {}
    for i in range(n):
        for j in range(i + width - 1, n):
            c = i + int(np.argmin(values[i : j + 1]))
            a, b = spans.get(c, (c, c))
            spans[c] = (min(a, i), max(b, j))
    return sorted((a, c, b) for c, (a, b) in spans.items())


def test_compact_windows_cover_every_stretch():
    rng = np.random.default_rng(0)
    for n, high in ((0, 9), (5, 9), (30, 4), (60, 1000), (80, 12)):
        values = rng.integers(0, high, n).astype(np.uint64)
        assert sorted(P.compact_windows(values, width=7)) == slow_windows(values, 7)


def test_stretch_hashes_depend_on_content_only():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (200, 300))
    b[120:220] = a[30:130]
    hashes = lambda x: P.stretch_hashes(x, np.arange(len(x) - 45), np.arange(46, len(x) + 1))
    x, y = hashes(a), hashes(b)
    assert (x[30:85] == y[120:175]).all()
    assert len({*x.tolist(), *y.tolist()}) == len(x) + len(y) - 55


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def corpus():
    rng = random.Random(11)
    line, passage = words(rng, 20), words(rng, 60)  # a common short line, a common long passage
    docs, want = [], {}
    for i in range(60):
        body = [*words(rng, rng.randrange(80)), *line, *words(rng, rng.randrange(80))]
        if i % 3 == 0:
            at = rng.randrange(len(body) + 1) if i % 2 else 0
            body[at:at] = passage
            want[i] = "hot"
        docs.append(body)
    pair = words(rng, 52)
    for i, (a, b) in enumerate(((5, 90), (70, 0))):
        docs.append([*words(rng, a), *pair, *words(rng, b)])
        want[60 + i] = "pair"
    near = words(rng, 150)
    other = list(near)
    other[75] = "changed"
    other[20:21] = []
    docs += [near, other]
    want |= {62: "near", 63: "near"}
    short = words(rng, 49)
    docs += [[*words(rng, 30), *short], [*short, *words(rng, 30)]]  # 49 words aren't a passage
    inner = words(rng, 55)
    docs.append([*inner, *words(rng, 40), *inner])
    want[66] = "inner"
    return docs, want, passage, pair


def test_passages_are_found_and_clean_documents_left_alone(spark):
    docs, want, passage, pair = corpus()
    texts = [" ".join(d) for d in docs]
    rows = [(i, t, 0, "s") for i, t in enumerate(texts)]
    rows += [(100, texts[1].upper(), 0, None), (101, "\n".join(docs[1]), 0, None), (102, "same short", 0, ""), (103, "same short", 0, ""), (104, None, 0, ""), (None, texts[0], 0, "")]
    found = {r.doc_id: r for r in P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, n long, spans string")).collect()}
    assert set(found) == set(want) | {1, 100, 101}
    for i, kind in want.items():
        mates = [j for j, k in want.items() if k == kind]
        assert found[i].class_id == min(mates), (i, kind)
    for i, kind in want.items():
        covered = {p for s in found[i].spans for p in range(s.start, s.end)}
        target = {"hot": passage, "pair": pair}.get(kind)
        if target:
            at = next(p for p in range(len(docs[i])) if docs[i][p : p + len(target)] == target)
            assert set(range(at, at + len(target))) <= covered
            assert len(covered) <= len(target) + 24  # near stretches may take in a few words beside
    assert found[100].class_id == 1 and [(s.start, s.end) for s in found[100].spans] == [(0, len(docs[1]))]
    assert len(found[66].spans) == 2


def shingle_sets(body):
    """Shingle set of every stretch of 50 words."""
    runs = [tuple(body[i : i + 5]) for i in range(len(body) - 4)]
    return [set(runs[i : i + 46]) for i in range(len(runs) - 45)]


def similar(x, y):
    """Whether a stretch of x reaches 0.8 with the one of y at its place or one beside (passages are aligned here)."""
    return any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(x) for b in y[max(0, i - 1) : i + 2])


def edited(rng, passage, kind):
    out, at = list(passage), rng.randrange(2, len(passage) - 2)
    out[at : at + (kind != "put in")] = [] if kind == "taken out" else words(rng, 1)
    return out


@pytest.mark.parametrize(("copies", "partitions"), [(2, 4), (12, 4), (60, 1), (60, 4), (60, 64)])
def test_all_near_repeats_are_linked(spark, copies, partitions):
    """Against all pairs: few copies go pair by pair, many by the stars; neither depends on the partitions."""
    rng = random.Random(copies)
    docs, group = [], []
    for g in range(2 if copies > 12 else 6):
        passage = words(rng, rng.choice([52, 60, 90]))
        for i in range(copies):
            docs.append(edited(rng, passage, rng.choice(["changed", "put in", "taken out"])) if i else passage)
            group.append(g)
    line = words(rng, 20)  # stands in all texts and is no passage
    texts = [" ".join([*words(rng, rng.randrange(40)), *line, *words(rng, 9), *d, *words(rng, rng.randrange(60))]) for d in docs]
    sets = [shingle_sets(d) for d in docs]
    want = [(i, j) for i in range(len(docs)) for j in range(i) if group[i] == group[j] and similar(sets[i], sets[j])]
    found = P.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions))
    classes = {r.doc_id: r.class_id for r in found.collect()}
    assert len(want) > copies / 2
    assert all(classes.get(i, -1) == classes.get(j, -2) for i, j in want)
    assert all(len({group[i] for i, c in classes.items() if c == k}) == 1 for k in set(classes.values()))


@pytest.mark.parametrize("full", ["repeated", "frequent", "near"])
def test_full_filters_lose_nothing(spark, monkeypatch, full):
    """A filter that takes every value in (as at sizes far beyond its own) leads to the same classes."""
    rng = random.Random(6)
    texts = []
    for _ in range(10):
        one = words(rng, 70)
        texts += [" ".join(one), " ".join(edited(rng, one, "changed"))]
    hot = words(rng, 70)
    texts += [" ".join([*words(rng, 30), *edited(rng, hot, "changed")]) for _ in range(30)] + [" ".join(hot)]
    nodes = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = lambda: sorted((r.doc_id, r.class_id) for r in P.repeated_passages(nodes).collect())
    right = classes()
    assert [d for d, _ in right] == list(range(51)) and len({c for _, c in right}) == 11
    whole, calls = P._filter, []

    def filled(keys, n):
        calls.append(n)
        real = whole(keys, n)
        return np.full_like(real, 255) if ["repeated", "frequent", "near"].index(full) == min(len(calls) - 1, 2) else real

    monkeypatch.setattr(P, "_filter", filled)
    assert classes() == right


def test_repeated_rows_and_long_texts(spark):
    rng = random.Random(3)
    passage = words(rng, 52)
    long = [*words(rng, 30_000), *passage, *words(rng, 30_000)]
    rows = [(1, " ".join(long)), (1, " ".join(long)), (2, " ".join(passage)), (3, "q " * 20_000), (4, "")]
    found = {r.doc_id: r for r in P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.class_id for i, r in found.items() if i != 3} == {1: 1, 2: 1}
    assert [tuple(s) for s in found[1].spans] == [(30_000, 30_052)]


def test_empty(spark):
    assert P.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shingles_near_frequent_windows_are_kept_small():
    """Equal ends are written once, and rows that the filter clears aren't passed on."""
    import pyarrow as pa

    class Full:
        value = np.full(1 << 17, 255, np.uint8)

    class Empty:
        value = np.zeros(1 << 17, np.uint8)

    text = " ".join(f"w{i}" for i in range(120)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text + b" other"], pa.binary())], ["node", "text"])
    rows = [r for b in P._windows(Full, Full)(iter([batch])) for r in b.to_pylist() if r["kind"] == P.NEAR]
    assert rows and all(r["next_min"] is not None and r["last_max"] is None for r in rows)
    assert sum(r["next_max"] is not None for r in rows) == 1  # the last shingle of one text is followed by another in the other
    keys = pa.RecordBatch.from_arrays([pa.array([r["key"] for r in rows])], ["key"])
    assert sum(b.num_rows for b in P._repeated(Full)(iter([keys]))) == len(rows)
    assert sum(b.num_rows for b in P._repeated(Empty)(iter([keys]))) == 0


def test_shingles_beyond_repeated_runs_are_not_counted():
    """Around a frequent line in different texts, only what a similar stretch can reach; all of a shared stretch."""
    import pyarrow as pa

    class Filter:
        def __init__(self, values):
            self.value = np.zeros(1 << 17, np.uint8)
            at = values.view(np.int64) & np.int64(8 * len(self.value) - 1)
            np.bitwise_or.at(self.value, at >> 3, (1 << (at & 7)).astype(np.uint8))

    rng = random.Random(5)
    line, passage = words(rng, 26), words(rng, 60)
    apart = [" ".join([*words(rng, 90), *line, *words(rng, 90)]).encode() for _ in range(40)]
    alike = [" ".join([*words(rng, 90), *edited(rng, passage, "changed"), *words(rng, 90)]).encode() for _ in range(40)]
    for texts, far in ((apart, True), (alike, False)):
        found = [P.shingles(t) for t in texts]
        minima = [P.min_hash(x)[P.minima(P.min_hash(x))] for x in found]
        values, n = np.unique(np.concatenate(minima), return_counts=True)
        seen, often = Filter(values[n > 1]), Filter(values[n > P.PAIRWISE])
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["node", "text"])
        rows = [r for b in P._windows(seen, often)(iter([batch])) for r in b.to_pylist() if r["kind"] == P.NEAR]
        held, shared = {r["key"] for r in rows}, P.shingles(" ".join(passage).encode()).view(np.int64).tolist()
        if far:
            most = [P._area(len(x), np.flatnonzero(P.minima(P.min_hash(x)) & P._inside(often.value, P.min_hash(x)))).sum() for x in found]
            assert 0 < sum(r["node"] for r in rows) < 0.9 * sum(most)
        else:
            assert set(shared) <= held


def test_copies_that_double_a_word_are_linked(spark):
    """A word put in beside its like breaks fewer shingles of the other text than any other word does."""
    rng = random.Random(8)
    for run in (1, 2, 3):
        passage = words(rng, 56)
        passage[26 : 26 + run] = [passage[26]] * run
        docs = [[*passage[:26], *[passage[26]] * (i % 2), *passage[26:]] for i in range(40)]
        texts = [" ".join([*words(rng, 10 + i), *d, *words(rng, 30)]) for i, d in enumerate(docs)]
        sets = [shingle_sets(d) for d in docs[:2]]
        assert similar(*sets)
        found = P.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        assert [r.class_id for r in found] == [0] * 40, run


def test_shingles_shared_by_chance_are_not_passed_on(spark, monkeypatch):
    """Near a frequent line, phrases that stand twice are met more the larger the table is; without a stretch that is
    similar to another one, their neighbours aren't asked for. Those around an edit are."""
    rng = random.Random(9)
    line, passage, phrases = words(rng, 26), words(rng, 60), [words(rng, 8) for _ in range(5)]
    chance = [" ".join([*words(rng, 60), *phrases[i % 5], *words(rng, 3), *line, *words(rng, 60)]) for i in range(40)]
    alike = [" ".join([*words(rng, 60), *edited(rng, passage, "changed"), *words(rng, 60)]) for _ in range(40)]
    real, rows = P.materialize, {}

    def counted(table, name, *args, **named):
        out = real(table, name, *args, **named)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(P, "materialize", counted)
    for texts, some in ((chance, False), (alike, True)):
        P.passage_links(spark.createDataFrame(list(enumerate(texts)), "node long, text string"))
        assert rows["near"] > 20
        assert (rows["sides"] > 0) == some
