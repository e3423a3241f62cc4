"""Personal data by a skip-chain conditional random field over candidate tokens."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.sampling import bounded_sample, slices

# The base patterns, in the order of kinds.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Rows that the field's weights are fitted on, and characters that they may have together.
TRAIN_ROWS, TRAIN_CHARS = 4000, 8_000_000
#: Messages are passed until they change by less; the limit of rounds only ends a field that swings for ever.
ROUNDS, CLOSE = 1000, 1e-4
#: Candidates this near in the text are neighbours of the chain.
NEAR = 40
_LABELS = ("none", *KINDS)

# Candidates beyond the base spans: what could be personal data if something else in the document says so.
_MAIL_WORDS = re.compile(r"[A-Za-z0-9._%+-]{2,64}[ ]?[\[(]?(?:@|\bat\b)[\])]?[ ]?[A-Za-z0-9-]{1,64}(?:[ ]?[\[(]?(?:\.|\bdot\b)[\])]?[ ]?[A-Za-z0-9-]{2,64}){1,4}")
_NUMBERS = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}")
_SHAPES = ("base", "mail words", "3-3-4", "short number", "long number", "card length")
#: Words shortly ahead of a token that speak for a kind; the last one counts.
_CUES = re.compile(r"(?i)\b(?:(e-?mail|mail|write to|contact)|(phone|tel|call|mobile|fax)|(card|visa|credit)|(ip|host|server))\b")
CUE_REACH = 24
#: A text without this has no candidates: they hold an @, digits or, in a text with one, the word dot.
POSSIBLE = "[0-9@]|dot"
#: Prior means of the weights: a look-alike isn't personal data, its entity's label speaks for it, and so does a cue.
_LOOK_ALIKE, _SAME, _CUE = -2.2, 1.4, 1.0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


# The patterns again, in forms that take linear time on long runs: an address is looked for around each @, and a
# number can only begin where its run of digits does.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP_AT_RUN = re.compile("(?<![0-9])" + IP.pattern)


def emails(text: str) -> list[tuple[int, int, int]]:
    """(start, 0, end) of EMAIL's matches."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at)):
            done = domain.end()
            found.append((start, 0, done))
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' good matches; each kind is matched leftmost and on its own."""
    found = emails(text)
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in _IP_AT_RUN.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


@dataclass
class Candidate:
    start: int
    end: int
    shape: int
    core: str
    label: int  # of base spans; else 0
    cue: int = 0  # kind that the words ahead speak for, from one; else 0


def _core(text: str, kind_is_mail: bool) -> str:
    """What similar tokens have in common: the last ten digits, or an address with its separators spelled out."""
    if kind_is_mail:
        plain = re.sub(r"[\[\]()\s]", "", re.sub(r"\s*[\[(]?\bdot\b[\])]?\s*", ".", re.sub(r"\s*[\[(]?\bat\b[\])]?\s*", "@", text.lower())))
        return plain.strip(".")
    return re.sub("[^0-9]", "", text)[-10:]


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[Candidate]:
    """Base spans and looser look-alikes outside them, in order."""
    nodes = [Candidate(a, b, 0, _core(text[a:b], k == 0), k + 1) for a, k, b in spans]
    starts, reach = [], []  # of the spans in order, and how far any of them so far reaches
    for a, _, b in sorted(spans):
        starts.append(a)
        reach.append(max(b, reach[-1] if reach else 0))

    def free(a: int, b: int) -> bool:
        before = bisect_left(starts, b)  # spans that start ahead of b
        return not before or reach[before - 1] <= a

    if "@" in text or "dot" in text:
        nodes += [Candidate(m.start(), m.end(), 1, _core(m[0], True), 0) for m in _MAIL_WORDS.finditer(text) if free(m.start(), m.end())]
    for m in _NUMBERS.finditer(text):
        if free(m.start(), m.end()):
            digits = re.sub("[^0-9]", "", m[0])
            shape = 2 if len(digits) == 10 else 3 if len(digits) < 10 else 5 if len(digits) >= 12 else 4
            nodes.append(Candidate(m.start(), m.end(), shape, digits[-10:], 0))
    for c in nodes:
        for m in _CUES.finditer(text, max(0, c.start - CUE_REACH), c.start):
            c.cue = KINDS.index({1: "email", 2: "phone", 3: "card", 4: "ip"}[m.lastindex]) + 1
    return sorted(nodes, key=lambda c: (c.start, c.label))


def entities(nodes: list[Candidate]) -> list[tuple[int, list[int]]]:
    """(label, look-alikes) of what the tokens name: a star each, so the number of edges is linear.

    An entity is a core, or the last seven digits of phone-like tokens. Its label is the one most base spans of it
    have, the first of equals; 0 if it has none. A look-alike belongs to the entity of its core if that has a label or
    its last digits have none, else to that of its last digits.
    """
    named: dict[str, dict[int, int]] = {}  # by core, and by last digits with a mark that no core has
    keys = [(c.core, f"…{c.core[-7:]}" if c.core.isdigit() and len(c.core) >= 7 else c.core) for c in nodes]
    for c, pair in zip(nodes, keys):
        if c.label:
            for key in set(pair):
                counts = named.setdefault(key, {})
                counts[c.label] = counts.get(c.label, 0) + 1
    members: dict[str, list[int]] = {}
    for i, (c, (core, last)) in enumerate(zip(nodes, keys)):
        if not c.label:
            members.setdefault(last if last in named and core not in named else core, []).append(i)
    label = {key: max(counts, key=counts.__getitem__) for key, counts in named.items()}
    return [(label.get(key, 0), found) for key, found in members.items()]


def sum_product(unary: np.ndarray, ends: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Marginals of a pairwise field by loopy message passing with damping; exact where the edges form trees.

    unary: log potentials, nodes x labels; ends: edges x 2; pair: log potentials, edges x labels x labels.
    """
    m, k = len(ends), unary.shape[1]
    if not m:
        return _softmax(unary)
    # messages 0..m-1 go from first to second end, m..2m-1 back
    source, target = np.r_[ends[:, 0], ends[:, 1]], np.r_[ends[:, 1], ends[:, 0]]
    pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.r_[np.arange(m, 2 * m), np.arange(m)]
    messages = np.zeros((2 * m, k))
    for _ in range(ROUNDS):
        incoming = unary.copy()
        np.add.at(incoming, target, messages)
        out = incoming[source] - messages[back]
        fresh = np.logaddexp.reduce(out[:, :, None] + pair, axis=1)
        fresh -= fresh.max(axis=1, keepdims=True)
        change = np.abs(fresh - messages).max()
        messages = 0.5 * messages + 0.5 * fresh
        if change < CLOSE:
            break
    incoming = unary.copy()
    np.add.at(incoming, target, messages)
    return _softmax(incoming)


def _neighbours(nodes: list[Candidate]) -> list[tuple[int, int]]:
    return [(i - 1, i) for i in range(1, len(nodes)) if nodes[i].start - nodes[i - 1].end <= NEAR]


class SkipChain:
    """Log potentials: of a shape and label, of a cue and label, of neighbours' labels, of the labels of an entity and
    a token of it, and of the label of an entity that no base span names."""

    def __init__(self, shape: np.ndarray, cue: np.ndarray, chain: np.ndarray, skip: np.ndarray, unnamed: np.ndarray):
        self.shape, self.cue, self.chain, self.skip, self.unnamed = shape, cue, chain, skip, unnamed

    @classmethod
    def fit(cls, texts: list[str | None]) -> SkipChain:
        """The weights of highest pseudo-likelihood (each token's label given those around it) under Gaussian priors.

        Base spans have their labels; a look-alike has that of its entity, none if no base span names it. Without
        texts the prior means remain.
        """
        k = len(_LABELS)
        means = [np.zeros((len(_SHAPES), k)), np.zeros((k, k)), np.zeros((k, k)), np.full((k, k), -_SAME) + 2 * _SAME * np.eye(k)]
        means[0][1:, 1:] = _LOOK_ALIKE
        means[1][np.arange(1, k), np.arange(1, k)] = _CUE
        strength = [50.0, 1.0, 1.0, 1.0]
        given: list[list[np.ndarray]] = [[], [], [], [], []]  # shapes, cues, labels before, labels behind, entity's label
        truth: list[int] = []
        unnamed = np.full(k, 0.5)
        unnamed[0] = 4.5
        one = np.eye(k)
        for text in texts:
            nodes = candidates(text or "", base_spans(text or ""))
            told, named = [c.label for c in nodes], np.zeros((len(nodes), k))
            for label, members in entities(nodes):
                unnamed[0] += not label
                for i in members:
                    told[i], named[i, label] = label, 1
            sides = np.zeros((2, len(nodes), k))
            for i, j in _neighbours(nodes):
                sides[0, j, told[i]] += 1
                sides[1, i, told[j]] += 1
            if nodes:
                cue = one[[c.cue for c in nodes]]
                cue[:, 0] = 0
                for column, rows in zip(given, (np.eye(len(_SHAPES))[[c.shape for c in nodes]], cue, *sides, named)):
                    column.append(rows)
            truth += told
        weights = [m.copy() for m in means]
        if truth:
            shapes, cues, before, behind, entity = (np.concatenate(c) for c in given)
            step = [[np.zeros_like(m) for m in means] for _ in range(2)]
            for t in range(1, 201):  # Adam; the objective is concave
                shape, cue, chain, skip = weights
                p = one[truth] - _softmax(shapes @ shape + cues @ cue + before @ chain + behind @ chain.T + entity @ skip)
                slope = [shapes.T @ p, cues.T @ p, before.T @ p + p.T @ behind, entity.T @ p]
                for i in range(4):
                    g = slope[i] - strength[i] * (weights[i] - means[i])
                    step[0][i], step[1][i] = 0.9 * step[0][i] + 0.1 * g, 0.99 * step[1][i] + 0.01 * g * g
                    weights[i] = weights[i] + 0.05 * step[0][i] / (1 - 0.9**t) / (np.sqrt(step[1][i] / (1 - 0.99**t)) + 1e-9)
        return cls(*weights, np.log(unnamed / unnamed.sum()))

    def field(self, nodes: list[Candidate]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unary, ends, pair) of the tokens and, behind them, their entities; what base spans name is observed."""
        n, k = len(nodes), len(_LABELS)
        stars = entities(nodes)
        unary = np.concatenate([self.shape[[c.shape for c in nodes]] + np.array([self.cue[c.cue] * (c.cue > 0) for c in nodes]), np.tile(self.unnamed, (len(stars), 1))])
        for i, label in enumerate([c.label for c in nodes] + [label for label, _ in stars]):
            if label:
                unary[i] = -1e9  # beyond what any number of messages adds up to
                unary[i, label] = 0.0
        near = _neighbours(nodes)
        far = [(n + e, i) for e, (_, members) in enumerate(stars) for i in members]
        pair = np.concatenate([np.broadcast_to(self.chain, (len(near), k, k)), np.broadcast_to(self.skip, (len(far), k, k))])
        return unary, np.array(near + far, np.int64).reshape(-1, 2), pair

    def beliefs(self, nodes: list[Candidate]) -> np.ndarray:
        """Marginals of the tokens by loopy sum-product."""
        return sum_product(*self.field(nodes))[: len(nodes)]

    def spans(self, text: str | None) -> list[tuple[int, int, int, str]]:
        """(start, kind, end, 'base' or 'field') in order: base spans, and look-alikes the field labels."""
        base = base_spans(text or "")
        found = [(a, k, b, "base") for a, k, b in base]
        nodes = candidates(text or "", base)
        # without a base span and a cue nothing speaks for any label
        if len(nodes) > len(base) and (base or any(c.cue for c in nodes)):
            for c, belief in zip(nodes, self.beliefs(nodes)):
                label = int(belief.argmax())
                if not c.label and label and belief[label] > 0.5:
                    found.append((c.start, label - 1, c.end, "field"))
        return sorted(found)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


_SPANS = "array<struct<start:long,kind:string,end:long,origin:string>>"


def _fit(docs: DataFrame, text_col: str, train_rows: int) -> SkipChain:
    likely = docs.filter(F.col(text_col).rlike("@|[0-9]{2}"))
    return SkipChain.fit([r[0] for r in bounded_sample(likely, train_rows, TRAIN_CHARS, F.col(text_col).alias("text"))])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, spans) for every row of docs; spans: start, kind, end, origin, by start and kind, in code points.

    Base patterns give observed nodes. Look-alikes in the same text (numbers without a plus, spelled-out
    addresses) are nodes without a label; neighbours share chain edges and equal or similar tokens, however far
    apart, skip edges to one entity, which has the label of its base spans. Loopy message passing labels a look-alike
    where the field believes it, so a number that stands once with its plus is found without it too, however often. In
    a text without base spans only words such as "call" ahead of look-alikes speak for a label.

    Weights are fitted on at most train_rows texts (TRAIN_CHARS characters), those of lowest hash that hold an @ or digits. Null text has no
    spans; null ids and repeated rows are kept. Other columns aren't read.
    """
    model = docs.sparkSession.sparkContext.broadcast(_fit(docs, text_col, train_rows))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("origin", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [[{"start": a, "kind": KINDS[k], "end": b, "origin": o} for a, k, b, o in model.value.spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, f"doc_id long, spans {_SPANS}")


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs with every span replaced by its kind in brackets; length_col, if there is one, is the new length. Null text
    stays null.

    Overlapping spans become one, named after the first. All other columns and rows stay as they are. Only texts that
    can have candidates go to Python; the field of the others has no nodes.
    """
    model = docs.sparkSession.sparkContext.broadcast(_fit(docs, text_col, train_rows))

    def cover(text: str | None) -> str | None:
        if text is None or not (spans := model.value.spans(text)):
            return text
        out, at = [], 0
        for start, kind, end, _ in spans:
            if start >= at:
                out += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    at = docs.columns.index(text_col)

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([cover(t.as_py()) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :]], batch.schema.names)

    # plain names on the way, since a name with a dot can't be handed to an Arrow function
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    possible = F.coalesce(F.col(f"c{at}").rlike(POSSIBLE), F.lit(False))
    out = numbered.filter(possible).mapInArrow(change, numbered.schema).unionByName(numbered.filter(~possible)).toDF(*docs.columns)
    return out.withColumn(length_col, F.char_length(F.col("`" + text_col + "`")).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind of the base spans, hash of them, and all spans as text."""
    base = F.filter("spans", lambda s: s["origin"] == "base")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
