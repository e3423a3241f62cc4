import random
from collections import Counter, defaultdict

from kinfold.llm import packing


def slow(items, capacity):
    """Best fit by scanning all bins."""
    clusters = [c for _, _, c in items if c is not None]
    bins, out, rest = [], [], []
    for i, (length, source, cluster) in enumerate(items):
        whole = max(0, -(-length // capacity) - 1)
        for piece in range(whole):
            out.append((i, piece, len(bins), 0, piece * capacity, capacity))
            bins.append(None)
        rest.append((length - whole * capacity, i, whole, source, cluster if clusters.count(cluster) > 1 else None))
    for length, i, piece, source, cluster in sorted(rest, key=lambda r: (-r[0], r[1])):
        fits = [(b["left"], n) for n, b in enumerate(bins) if b and b["left"] >= length and source not in b["sources"] and cluster not in b["clusters"]]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        b = bins[n]
        out.append((i, piece, n, capacity - b["left"], piece * capacity, length))
        b["left"] -= length
        b["sources"] |= {source} - {None}
        b["clusters"] |= {cluster} - {None}
    return out


def test_equals_scanning_all_bins():
    for seed in range(200):
        rng = random.Random(seed)
        items = [(rng.choice([0, 1, 5, 16, 17, 40, rng.randrange(16)]), rng.choice([None, "a", "a", "b", "c", "d"]), rng.choice([None, 1, 2, rng.randrange(99)])) for _ in range(120)]
        got = packing.pack_items(items, 16)
        assert sorted(got) == sorted(slow(items, 16))
        check(items, got, 16)


def check(items, placed, capacity):
    bins, cover = defaultdict(list), defaultdict(int)
    for i, piece, where, offset, start, n in placed:
        bins[where].append((offset, n, i))
        cover[i] += n
    for rows in bins.values():
        at = 0
        for offset, n, _ in sorted(rows):
            assert offset == at
            at += n
        assert at <= capacity
        for of in (1, 2):
            keys = [items[i][of] for _, _, i in rows if items[i][of] is not None]
            assert len(keys) == len(set(keys))
    assert all(cover[i] == items[i][0] for i in range(len(items)))


def test_takes_the_tightest_compatible_bin():
    # bins after 9, 8 and 7 words of sources a, b, c; the next item fits all three but conflicts with the tightest
    got = packing.pack_items([(9, "a", None), (8, "b", None), (7, "c", None), (1, "a", None)], 10)
    assert [r[2] for r in got] == [0, 1, 2, 1]


def test_documents_whole_table(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 3}", 1) for i in range(300)] + [(None, None, None, 1), (5, "w " * 5, "s2", 1), (900, "x" * 9 + " y" * 5000, "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, part int")
    found = packing.pack(docs, capacity=64).collect()
    assert sum(r.n_words for r in found) == sum(len((t or "").split()) for _, t, _, _ in rows)
    source, text = {r[0]: r[2] for r in rows}, {r[0]: (r[1] or "").split() for r in rows}
    bins = defaultdict(list)
    for r in found:
        bins[r.bin_id].append(r)
    for members in bins.values():
        assert sum(r.n_words for r in members) <= 64
        named = [source[r.doc_id] for r in members if source[r.doc_id]]
        assert len(named) == len(set(named))
        assert len({tuple(text[r.doc_id]) for r in members}) == len(members)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_repeated_rows_are_dealt_over_groups(spark, monkeypatch):
    """Rows of one id and text, or of no id, don't end in one task."""
    monkeypatch.setattr(packing, "PER_GROUP", 50)
    rows = [(1, "same text", "s")] * 500 + [(None, "other text", None)] * 500
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    groups = Counter(r.bin_id >> 32 for r in found)
    assert sum(groups.values()) == 1000 and len(groups) == 20 and max(groups.values()) < 100


def test_very_long_text_fills_whole_bins(spark):
    found = packing.pack(spark.createDataFrame([(1, "word " * 200_001, "s")], "doc_id long, text string, source string")).collect()
    assert sorted((r.piece, r.start_word, r.n_words) for r in found) == [(i, 2048 * i, 2048) for i in range(97)] + [(97, 97 * 2048, 200_001 - 97 * 2048)]
