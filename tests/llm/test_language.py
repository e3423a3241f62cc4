import math
import random

from kinfold.llm import language

STEMS = {"en": ["the", "of", "th", "ing", "er", "and", "wh"], "de": ["der", "sch", "ung", "ich", "und", "zu", "pf"], "fr": ["les", "eau", "que", "é", "oi", "des"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def table(spark, extra=()):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        lang = rng.choice(list(STEMS))
        declared = lang if rng.random() < 0.9 else rng.choice(list(STEMS))
        rows.append((i, text(rng, lang, rng.choice([3, 30, 300])), declared, f"https://h{i % 7}.{lang}/x", lang))
    return rows, spark.createDataFrame([r[:4] + ("v",) for r in rows] + list(extra), "doc_id long, text string, lang string, source string, vote string")


def test_held_out_accuracy(spark):
    rows, docs = table(spark)
    found = {r.doc_id: r for r in language.identify(docs, train_rows=60).collect()}
    assert sum(found[r[0]].language == r[4] for r in rows) >= 0.98 * len(rows)
    assert all(r.accepted for r in found.values())


def test_priors_decide_short_texts(spark):
    # 'in' says little; hosts of one suffix speak one language
    rows, docs = table(spark, [(900, "zu", None, "https://new.de/", "v"), (901, "th", "en", "https://h0.en/", "v")])
    found = {r.doc_id: r.language for r in language.identify(docs).collect()}
    assert (found[900], found[901]) == ("de", "en")


def test_odd_rows(spark):
    rows, docs = table(spark, [(900, None, "en", None, None), (901, "12 34 !!", None, "x", None), (None, "the of and thing", None, None, None), (0, "the of", "en", "", None), (902, "qxj vkq zzx kwq jjx " * 50, None, "s", None)])
    found = language.identify(docs).collect()
    assert len(found) == len(rows) + 5
    by_id = {r.doc_id: (r.language, r.accepted) for r in found}
    assert by_id[900] == by_id[901] == ("und", False)
    assert by_id[None] == ("en", True)
    assert by_id[902] == ("und", False)
    kept = language.keep_identified(docs)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id >= 900) == []
    assert kept.columns == docs.columns


def test_languages_of_a_small_share_are_classes(spark):
    rng = random.Random(3)
    greek, russian = ["το", "και", "της", "ναι", "ου"], ["не", "что", "ий", "ова", "по"]
    say = lambda stems: " ".join("".join(rng.choice(stems) for _ in range(2)) for _ in range(40))
    rows = [(i, text(rng, "en", 30), "en", "s") for i in range(1500)]
    rows += [(2000 + i, say(greek), "el" if i else None, "s") for i in range(8)] + [(3000 + i, say(russian), "ru", "s") for i in range(2)]
    found = {r.doc_id: (r.language, r.accepted) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), train_rows=200).collect()}
    assert {found[2000 + i] for i in range(8)} == {("el", True)}
    assert {found[3000 + i] for i in range(2)} == {("ru", True)}  # too few to learn, taken at their word
    assert all(found[i] == ("en", True) for i in range(1500))


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "the of", None, "x")], "doc_id long, text string, lang string, source string")
    assert [(r.language, r.accepted) for r in language.identify(docs).collect()] == [("und", False)]
    assert language.identify(docs.limit(0)).collect() == []


def test_long_text_in_pieces():
    rng = random.Random(1)
    model = language.TextModel.fit([(text(rng, lang, 200), lang) for lang in STEMS for _ in range(5)])
    long = text(rng, "de", 400_000)
    whole, size = model.score([long])
    assert len(long) > language._PIECE
    bucket, letter = language._buckets(language._bytes(long))
    assert size[0] == letter.sum()
    assert model.languages[int(whole[0][:-1].argmax())] == "de"


def test_sixty_languages_of_small_shares_are_kept(spark):
    """Shares of 0.2 to 5 per cent: none vanishes, and hardly a document gets another language."""
    rng, rows = random.Random(7), []
    for k in range(60):
        stems = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(rng.choice([2, 3]))) for _ in range(6)]
        for _ in range(8 if k < 40 else 20 if k < 55 else 150):
            rows.append((len(rows), " ".join("".join(rng.choice(stems) for _ in range(2)) for _ in range(40)), f"l{k:02}", "s"))
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), train_rows=1200).collect()}
    assert all(r.accepted for r in found.values())
    assert {r.language for r in found.values()} == {r[2] for r in rows}
    assert sum(found[r[0]].language == r[2] for r in rows) >= 0.98 * len(rows)


def test_fusion_equals_working_it_out_by_hand(spark):
    """Posteriors from the model's likelihoods and plain counts of the other documents' votes."""
    rows, docs = table(spark)
    docs = docs.limit(60).persist()
    given = sorted(docs.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    names = sorted({r.lang for r in given})
    model = language.TextModel.fit([(r.text, r.lang) for r in given], names)
    ll = model.score([r.text for r in given])[0]
    votes = [int(x[:-1].argmax()) for x in ll]
    host = [r.source.split("//")[1].split("/")[0] for r in given]
    suffix = [h.rsplit(".", 1)[1] for h in host]
    k, kinds = len(names), len({r.lang for r in given})
    for at, r in enumerate(given):
        others = [j for j in range(len(given)) if j != at]
        logs = []
        for i in range(k):
            n = lambda same: (sum(same(j) and votes[j] == i for j in others), sum(map(bool, map(same, others))))  # noqa: B023, E731
            (c, _), (s, s_all), (h, h_all), (d, _) = n(lambda j: True), n(lambda j: suffix[j] == suffix[at]), n(lambda j: host[j] == host[at]), n(lambda j: given[j].lang == r.lang)  # noqa: B023
            p = (c + language.CORPUS_STRENGTH / k) / (len(others) + language.CORPUS_STRENGTH)
            p = (s + language.SUFFIX_STRENGTH * p) / (s_all + language.SUFFIX_STRENGTH)
            p = (h + language.HOST_STRENGTH * p) / (h_all + language.HOST_STRENGTH)
            logs.append(math.log(p) + math.log((d + 1) / (c + max(1, kinds))) + language.TEMPER * ll[at][i])
        want = 1 / sum(math.exp(x - max(logs)) for x in logs)
        assert got[r.doc_id].language == names[logs.index(max(logs))]
        assert abs(got[r.doc_id].posterior - want) < 1e-3
