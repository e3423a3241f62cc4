import random

import xxhash

from kinfold.llm import simhash


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    n, least = len(prints), list(range(len(prints)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return [root(i) for i in range(n)]


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    base = [word() for _ in range(300)]
    texts = [None, "", " \n", "One", "one", "ONE two", "one two three", "one two three\x0bfour"]
    for _ in range(120):  # a large group of near copies, more than a bucket is compared pairwise
        near = list(base)
        near[rng.randrange(300)] = word()
        texts.append(" ".join(near))
    texts += [" ".join(word() for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    return texts + texts[10:20]


def test_against_all_pairs(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    want = slow_components(prints)
    assert found == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, want))}
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == set(want)


def test_chains_are_followed_through_large_and_small_buckets(spark):
    prints = [0]
    rng = random.Random(5)
    for _ in range(60):
        prints.append(prints[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints += [rng.getrandbits(10) for _ in range(100)]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    pairs = simhash.close_pairs(fps).collect()
    plain = [p & (2**64 - 1) for p in signed]
    want = slow_components(plain)
    from kinfold.operators.components import components

    root = {r.node: r.root for r in components(spark.createDataFrame([(a, b) for a, b in pairs], "a long, b long")).collect()}
    mine = [root.get(p, p) for p in signed]
    groups = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == y) for y in set(labels))
    assert groups(mine) == groups(want)


def test_empty_and_null_ids(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "other words here now")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.simhash_components(docs).collect())
    assert got == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]


def shingle_set(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def slow_near(texts):
    """Least place of every text's component under a Jaccard similarity of 0.8 over 5-word shingles."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if 4 * max(len(x), len(sets[j])) <= 5 * min(len(x), len(sets[j])) and len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def test_similar_texts_are_found(spark):
    """Pairs, a group beyond the pairwise bound, texts of a few words, and a common text in otherwise different ones."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))

    def edited(words, n):
        out = list(words)
        for at in rng.sample(range(len(out)), n):
            out[at] = word()
        return out

    texts = ["", None, " ", "one two", "ONE\ttwo", "one two three", "a b c d e f", "a b c d e g"]
    for size in (40, 120, 700):
        for _ in range(8):
            base = [word() for _ in range(size)]
            texts += [" ".join(base), " ".join(edited(base, max(1, size // 90))), " ".join(edited(base, size // 10))]
    hot, line = [word() for _ in range(150)], [word() for _ in range(60)]
    texts += [" ".join(edited(hot, rng.choice([0, 1, 1, 2]))) for _ in range(80)]
    texts += [" ".join([*line, *(word() for _ in range(30))]) for _ in range(60)]  # alike, but not enough
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    found = {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()}
    assert [found[i] for i in range(len(texts))] == slow_near(texts)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(slow_near(texts)))
    assert simhash.near_components(docs.limit(0)).collect() == []


def test_recall_in_a_large_group(spark):
    """An original and copies with up to three edits, most of which are alike to the original only."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, texts = [word() for _ in range(150)], []
    for i in range(300):
        out = list(base)
        for at in rng.sample(range(150), i % 4 if i else 0):
            out[at] = word()
        texts.append(" ".join(out))
    want = slow_near(texts)
    found = {r.doc_id: r.component_id for r in simhash.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    pairs = [(i, j) for i in range(300) for j in range(i) if want[i] == want[j]]
    assert sum(found[i] == found[j] for i, j in pairs) >= 0.99 * len(pairs)
    assert all(want[i] == want[j] for i in range(300) for j in range(i) if found[i] == found[j])


def test_pairs_that_the_first_texts_of_a_large_band_miss(spark):
    """Pairs alike to each other and to no other of a large group, and texts of a few words; all are linked, no others."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, texts = [word() for _ in range(250)], ["a b c d e f g", "a b c d e f h"]
    for _ in range(90):
        out = list(base)
        for at in rng.sample(range(20, 250), 4):
            out[at] = word()
        texts.append(" ".join(out))
        out[rng.randrange(20)] = word()
        texts.append(" ".join(out))
    want = slow_near(texts)
    assert len(set(want)) > 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_across_components_against_all_pairs(spark):
    """Every similar pair of different components and no other, for sets of many sizes and some known components."""
    rng = random.Random(19)
    sets = [sorted(rng.sample(range(1, 60), rng.choice([1, 2, 5, 10, 40, 50, 54]))) for _ in range(120)]
    sets += [[x for x in sets[rng.randrange(120)] if rng.random() < 0.9] or [7] for _ in range(120)]
    rows = [(i, len(x), b"".join((v * 70_000_001 % 2**32).to_bytes(4, "little") for v in x)) for i, x in enumerate(sets)]
    roots = {i: i % 7 for i in range(0, 240, 3)}
    alike = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    want = {(i, j) for j in range(240) for i in range(j) if roots.get(i, -i - 1) != roots.get(j, -j - 1) and alike(set(sets[i]), set(sets[j]))}
    tables = [simhash.materialize(spark.createDataFrame(x, t), "given") for x, t in ((rows, "node long, size int, hashes binary"), (sorted(roots.items()), "node long, root long"))]
    assert len(want) > 100
    assert {tuple(r) for r in simhash.across_components(tables[0].select("node"), tables[1], tables[0]).collect()} == want
