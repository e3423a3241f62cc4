import hashlib
import itertools
import random
import re
from collections import defaultdict
from functools import partial
from types import SimpleNamespace

import numpy as np
import pytest

from kinfold.llm import pii


def slow_base(text):
    """The base patterns, written from their description."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(map(int, m[0].split("."))) <= 255:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and doubled % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len([c for c in m[0] if c in "0123456789"]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(4)
    out = ["", "a@b.c", "x é😀 joe@mail.example.com.", "4111 1111-1111 1111", "1.2.3.4.5 256.1.1.1 001.002.003.004", "+1 (838) 555-7235", "+1 23", "12345678901234567890123", "a@b@c.d", "1" * 5000, "a@b.c@d.e x@@y.z", "a-b@-.-", "q" * 3000 + "@ @x.y"]
    for _ in range(300):
        out.append("".join(rng.choice(["1", "2", "45", "4111111111111111", "+", " ", "-", ".", "(", "@", "ab", "é", "1.1.1.1", "x.y"]) for _ in range(rng.randrange(40))))
    return out


@pytest.fixture(scope="module")
def model():
    return pii.SkipChain.fit([])


def test_base_spans_equal_a_plain_reading(model):
    for text in texts():
        assert pii.base_spans(text) == slow_base(text), text
        assert [s[:3] for s in model.spans(text) if s[3] == "base"] == slow_base(text)


def test_skip_edges_label_look_alikes(model):
    text = "call +1 (838) 555-7235 now. " + "word " * 500 + "or 838-555-7235, not 838-555-0000. joe.b@mail.org is joe.b [at] mail [dot] org"
    found = [(text[a:b], pii.KINDS[k], origin) for a, k, b, origin in model.spans(text)]
    assert ("+1 (838) 555-7235", "phone", "base") in found
    assert ("838-555-7235", "phone", "field") in found
    assert ("joe.b [at] mail [dot] org", "email", "field") in found
    assert not any("0000" in t for t, _, _ in found)


def test_clean_texts_are_left_alone(model):
    for text in ["Call 838-555-7235.", "In 2020 and 2021 we met at noon dot", "x" * 50_000, "1 2 3", None]:
        assert model.spans(text) == []


def test_long_runs_take_linear_time(model):
    for text in ("a" * 200_000 + " @", "1" * 200_000 + ".", "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1.1.1.1 " * 20_000):
        model.spans(text)


def test_held_out_accuracy():
    rng = random.Random(8)

    def document():
        number = "".join(str(rng.randrange(10)) for _ in range(10))
        other = "".join(str(rng.randrange(10)) for _ in range(10))
        show = lambda n: rng.choice(["{}-{}-{}", "({}) {}-{}", "{} {} {}"]).format(n[:3], n[3:6], n[6:])
        filler = " ".join("abc" for _ in range(rng.randrange(5, 60)))
        return f"+1 {show(number)} {filler} {show(number)} {filler} {show(other)} {filler}", number, other

    model, right, wrong = pii.SkipChain.fit([document()[0] for _ in range(200)]), 0, 0
    for _ in range(200):
        text, number, other = document()
        cores = [re.sub("[^0-9]", "", text[a:b]) for a, k, b, origin in model.spans(text) if origin == "field" and k == 3]
        right += cores == [number]
        wrong += other in cores
    assert right >= 195 and wrong == 0


@pytest.mark.parametrize("repeats", [1, 2, 10, 100])
@pytest.mark.parametrize("trained", [0, 200])
def test_every_repeat_is_found(repeats, trained):
    rng = random.Random(9)
    number = lambda: "".join(rng.choice("23456789") for _ in range(10))
    show = lambda n: f"{n[:3]}-{n[3:6]}-{n[6:]}"
    filler = " word" * 20 + " "

    def document():
        n, other = number(), number()
        return f"+1 {show(n)}{filler}{show(n)}{filler}{show(other)}{filler}"

    model = pii.SkipChain.fit([document() for _ in range(trained)])
    for gap in (filler, ", "):
        for full, short, kind in (("+1 838 555 7235", "838-555-7235", 3), ("joe.b@mail.org", "joe.b [at] mail [dot] org", 0)):
            text = gap.join([full] + [short] * repeats) + filler + gap.join(["212-444-0000"] * repeats)
            found = [(text[a:b], k) for a, k, b, origin in model.spans(text) if origin == "field"]
            if trained and kind == 0:
                continue  # the sample has no addresses
            assert found == [(short, kind)] * repeats, (gap, short)


def test_documents_and_redaction(spark):
    rows = [(i, t, 0, "s") for i, t in enumerate(texts())] + [(None, None, 3, None), (0, "a@b.c", 0, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    found = pii.digest(pii.find_pii(docs)).collect()
    line = lambda t: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in slow_base(t or ""))
    want = sorted((str(i), hashlib.sha256(line(t).encode()).hexdigest(), *[sum(s[1] == k for s in slow_base(t or "")) for k in range(4)]) for i, t, _, _ in rows)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in found) == want
    clean = pii.redact(docs)
    assert clean.dtypes == docs.dtypes
    out = {(r.doc_id, r.text, r.n_chars) for r in clean.collect()}
    assert len(out) == len(rows)
    assert (None, None, None) in out and (1, "[EMAIL]", 7) in out
    assert not any(pii.EMAIL.search(t or "") for _, t, _ in out)
    assert pii.find_pii(docs.limit(0)).collect() == []


def enumerated(unary, ends, pair):
    """Marginals by summing over all labellings."""
    n, k = unary.shape
    total = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        weight = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + sum(p[labels[a], labels[b]] for (a, b), p in zip(ends, pair)))
        for i, y in enumerate(labels):
            total[i, y] += weight
    return total / total.sum(axis=1, keepdims=True)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 4, 6):  # trees: exact
        ends = np.array([(rng.integers(i), i) for i in range(1, n)], np.int64).reshape(-1, 2)
        unary, pair = rng.normal(0, 2, (n, 5)), rng.normal(0, 1.5, (len(ends), 5, 5))
        assert np.abs(pii.sum_product(unary, ends, pair) - enumerated(unary, ends, pair)).max() < 1e-3


@pytest.mark.parametrize("text", ["+1 838 555 7235, 838-555-7235, 838-555-7235", "838-555-7235 call 838-555-7235", "a@b.org 838-555-7235 +1 838 555 7235 212-444-0000"])
def test_fields_of_texts_agree_with_enumeration(model, text):
    nodes = pii.candidates(text, pii.base_spans(text))
    unary, ends, pair = model.field(nodes)  # chain and entities make loops
    got, want = pii.sum_product(unary, ends, pair), enumerated(np.maximum(unary, -50), ends, pair)
    assert (got.argmax(axis=1) == want.argmax(axis=1)).all()
    assert np.abs(got - want).max() < 0.1


def test_weights_are_those_of_highest_likelihood():
    """Numbers behind 'call' are phones in the sample, so the cue's weight grows; elsewhere it stays."""
    rng = random.Random(1)
    number = lambda: "".join(rng.choice("23456789") for _ in range(10))
    model, plain = pii.SkipChain.fit([f"please call +1 {number()} soon, item {number()}" for _ in range(200)]), pii.SkipChain.fit([])
    phone = pii.KINDS.index("phone") + 1
    assert model.cue[phone, phone] - model.cue[phone, 0] > plain.cue[phone, phone] - plain.cue[phone, 0] + 0.5
    assert np.abs(model.cue[1] - plain.cue[1]).max() < 1e-6
    assert model.unnamed[0] > plain.unnamed[0]


def test_texts_without_base_spans_are_in_the_field(model):
    nodes = pii.candidates("call 838-555-7235 or joe.b [at] mail [dot] org", [])
    assert [(c.shape, c.cue) for c in nodes] == [(2, 4), (1, 0)] or [(c.shape, c.cue) for c in nodes] == [(2, 4), (1, 4)]
    believed = model.beliefs(nodes)
    assert believed[0, 4] > model.beliefs(pii.candidates("item 838-555-7235", []))[0, 4]


def test_redact_without_length_column(spark):
    docs = spark.createDataFrame([(1, "a@b.c", 5)], "doc_id long, text string, `n.chars` long")
    assert [tuple(r) for r in pii.redact(docs).collect()] == [(1, "[EMAIL]", 5)]


def test_texts_without_candidates_stay_out_of_python(spark, model, monkeypatch):
    """A model that marks the first character of whatever it gets leaves texts alone that can't have candidates."""
    seen = defaultdict(partial(list, [(0, 0, 1, "base")]))
    monkeypatch.setattr(pii, "_fit", lambda *_: SimpleNamespace(spans=seen.__getitem__))
    rows = [(1, "plain words, + and at"), (2, "x 1"), (3, "a@b"), (4, "x at y dot z"), (5, None), (6, "")]
    clean = pii.redact(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, clean.collect())) == [(1, rows[0][1]), (2, "[EMAIL] 1"), (3, "[EMAIL]@b"), (4, "[EMAIL] at y dot z"), (5, None), (6, "")]
    for text in [*texts(), "call joe at mail dot org", "Write to JOE AT mail.org", "٣٤٥ ٣٤٥ ٣٤٥٦"]:
        assert re.search(pii.POSSIBLE, text) or not pii.candidates(text, pii.base_spans(text))
