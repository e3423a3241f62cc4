"""Near-duplicate passages by compact windows over token min-hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.exact_dedup import squeezed
from kinfold.llm.simhash import LOWER
from kinfold.operators.components import component_ids
from kinfold.runtime import anti_join_ids, discard, join_hot, materialize, membership_bitmap, split_by_bitmap, tidy

#: Words of a shingle, least words of a passage, least similarity.
SHINGLE, LEAST_WORDS, SIMILARITY = 5, 50, 0.8
#: Shingles of the shortest passage.
WIDTH = LEAST_WORDS - SHINGLE + 1
#: Shingles that the shortest similar stretches have in common at least.
LEAST_SHARED = int(np.ceil(2 * WIDTH * SIMILARITY / (1 + SIMILARITY) - 1e-9))
#: So they lack five each at most: one word put in, taken out or changed inside (or a few at the ends) cuts what they
#: share in two, and the longer part is a run of this many shingles. Every min-hash has its minimum over that run at
#: the same place in both, so compact windows of this width of a single min-hash meet for every similar pair.
RUN = -(-LEAST_SHARED // 2)
#: Shingles that one word put in, or one taken out or changed, breaks; fewer where the word stands beside its like.
GAPS = tuple(range(1, SHINGLE + 1))
#: Windows of one min-hash value that are compared pair by pair; more frequent values go by their blocks.
PAIRWISE = 16
#: Bits of a filter, by the number of its values (16 each) and between these bounds: 32 MB at most.
_LEAST_BITS, _MOST_BITS, _BITS = 20, 28, 32768
_SEED = np.uint64(xxhash.xxh64_intdigest(b"passage", 0))
_MIX, _BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as the longest text so far needs."""

    def __init__(self, base: int):
        self.base, self.inverse, self.size = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.size <= n:
            self.size = max(2 * n, 4096)
            grow = lambda x: np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.size, np.uint64(x))], dtype=np.uint64)
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up, self.down


_POWERS = _Powers(int(_BASE) | 1)


def stretch_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each values[start:end], the same wherever it stands: a polynomial, by differences of prefix sums."""
    up, down = _POWERS.upto(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    out = (prefix[ends] - prefix[starts]) * down[starts]
    return (out ^ (out >> np.uint64(31))) * _MIX


def shingles(text: bytes) -> np.ndarray:
    """64-bit hash of every run of SHINGLE words; too few words for a passage, none."""
    raw = np.frombuffer(text.translate(LOWER), np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    if len(starts) < LEAST_WORDS:
        return np.zeros(0, np.uint64)
    # bytes count from one, so that no word is a prefix of zeros of another
    words = stretch_hashes(raw.astype(np.uint64) + np.uint64(1), starts, ends)
    n = len(words) - SHINGLE + 1
    out = words[:n].copy()
    for i in range(1, SHINGLE):
        out = (out * _BASE) ^ words[i : i + n]
    return out ^ (out >> np.uint64(29))


def min_hash(shingle: np.ndarray) -> np.ndarray:
    x = (shingle ^ _SEED) * _MIX
    return x ^ (x >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every stretch of width, by doubling."""
    out, done = values, 1
    while 2 * done <= width:
        out, done = pick(out[..., :-done], out[..., done:]), 2 * done
    rest = width - done
    return pick(out[..., : out.shape[-1] - rest], out[..., rest:]) if rest else out


def minima(values: np.ndarray, width: int = RUN) -> np.ndarray:
    """Which places hold the minimum of some stretch of width; rows are apart. Equal values count both."""
    if values.shape[-1] < width:
        return np.zeros(values.shape, bool)
    low = _sliding(values, width, np.minimum)
    edge = np.zeros((*values.shape[:-1], width - 1), np.uint64)
    return _sliding(np.concatenate([edge, low, edge], axis=-1), width, np.maximum) == values


def compact_windows(values: np.ndarray, centers: np.ndarray | None = None, width: int = RUN) -> list[tuple[int, int, int]]:
    """(left, center, right), inclusive: every stretch within [left, right] that holds center has its minimum there.

    These are the nodes of the Cartesian tree whose spans are at least width, ties to the left. A node's ancestors
    span more than it, so it is enough to build the tree over the minima of all stretches of width.
    """
    n = len(values)
    places = (np.flatnonzero(minima(values, width)) if centers is None else centers).tolist()
    heights = values[places].tolist()
    left, right, stack = [0] * len(places), [n - 1] * len(places), []
    for i, h in enumerate(heights):
        while stack and heights[stack[-1]] > h:
            right[stack.pop()] = places[i] - 1
        left[i] = places[stack[-1]] + 1 if stack else 0
        stack.append(i)
    return [(x, c, y) for x, c, y in zip(left, places, right) if y - x >= width - 1]


class Codes:
    """Codes of the shingles from a center on and, backwards, before it; as a set too, for a quick refusal."""

    def __init__(self, after: bytes, before: bytes):
        self.after, self.before, self.set = after, before, None

    def distinct(self) -> frozenset:
        if self.set is None:
            self.set = frozenset(memoryview(self.after).cast("H")) | frozenset(memoryview(self.before).cast("H"))
        return self.set

    def may_match(self, other: Codes) -> bool:
        """False only if too few codes are common. Texts that repeat themselves have few codes and aren't refused."""
        x, y = self.distinct(), other.distinct()
        if 2 * len(x) <= len(self.after) + len(self.before) - 12 or 2 * len(y) <= len(other.after) + len(other.before) - 12:
            return True
        return len(x & y) >= LEAST_SHARED - 6

def _common(a: bytes, b: bytes) -> int:
    """Length of the common start of two runs of codes, in codes."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (n - (differ.bit_length() + 7) // 8) // 2


_HELD = np.zeros(1 << 16, bool)


def _held_in(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which codes of x are in y."""
    _HELD[y] = True
    found = _HELD[x]
    _HELD[y] = False
    return found


def same_passage(a: Codes, b: Codes) -> tuple[int, int] | None:
    """(shingles before the centers, shingles from them on) of near-duplicate stretches around two equal centers.

    Equal stretches of WIDTH shingles around the centers are taken as they are. Else the stretches are the union
    of all that hold the centers, have WIDTH shingles, and reach SIMILARITY as sets.
    """
    run, back = _common(a.after, b.after), _common(a.before, b.before)
    if run + back >= WIDTH:
        return back, run
    after, before = min(len(a.after), len(b.after)) // 2, min(len(a.before), len(b.before)) // 2
    if after + before < WIDTH or not a.may_match(b):
        return None
    x, y = (np.concatenate([np.frombuffer(c.before, "<u2")[:before][::-1], np.frombuffer(c.after, "<u2")[:after]]) for c in (a, b))
    shared = np.minimum(_windowed(_held_in(x, y)), _windowed(_held_in(y, x)))
    good = np.flatnonzero(shared >= LEAST_SHARED)
    good = good[(good <= before) & (good + WIDTH > before)]
    if not len(good) or not any(_similar(x, y, int(i)) for i in {good[0], good[len(good) // 2], good[-1]}):
        return None
    return before - int(good[0]), int(good[-1]) + WIDTH - before


def _similar(x: np.ndarray, y: np.ndarray, at: int) -> bool:
    """Whether the stretch of x from at on reaches SIMILARITY with y's at that place or, after an edit, one beside."""
    mine = set(x[at : at + WIDTH].tolist())
    others = (set(y[max(0, at + d) : at + d + WIDTH].tolist()) for d in (0, -1, 1))
    return any(len(mine & other) >= SIMILARITY * len(mine | other) for other in others)


def _windowed(flags: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[WIDTH:] - total[:-WIDTH]


#: Kinds of rows of the second pass over the texts: windows of a few, shingles near windows of many.
FEW, NEAR = 0, 1
_ENDS = ("next_min", "next_max", "last_min", "last_max")
_SIDES = pa.schema([(c, pa.int64()) for c in ("key", "n", *_ENDS)])
_WINDOW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("node", pa.int64()), ("at", pa.int32()), ("after", pa.binary()), ("before", pa.binary()), *((c, pa.int64()) for c in _ENDS)])
_WINDOW_ROWS = "kind int, key long, node long, at int, after binary, before binary, next_min long, next_max long, last_min long, last_max long"


def _filter(keys: DataFrame, n: int) -> np.ndarray:
    """One-hash filter of n keys, as bits; 32 MB at most reach the driver."""
    buckets = 1 << (min(_MOST_BITS, max(_LEAST_BITS, (16 * n).bit_length())) - _BITS.bit_length() + 1)
    at = F.pmod("key", F.lit(buckets * _BITS))
    rows = keys.groupBy((at / _BITS).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(at % _BITS).alias("bits"))
    out = np.zeros((buckets, _BITS // 8), np.uint8)
    for bucket, bits in rows.collect():
        out[bucket] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _inside(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.int64) & np.int64(8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _text_batches(batches: Iterator[pa.RecordBatch], every: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(node, shingles) of the texts long enough for a passage, or of every text."""
    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = shingles(text.as_buffer().to_pybytes() if text.is_valid else b"")
            if every or len(found):
                yield node, found


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Min-hash values of the centers of all compact windows (and of ties, which only adds to counts)."""
    held: list[np.ndarray] = []
    size = 0

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["key"])

    for _, found in _text_batches(batches):
        values = min_hash(found)
        held.append(values[minima(values)])
        size += len(held[-1])
        if size > 200_000:
            yield sent()
            held, size = [], 0
    if held:
        yield sent()


def _area(n: int, centers: np.ndarray) -> np.ndarray:
    """Which of n shingles a stretch of WIDTH shingles with one of the centers can hold."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(0, centers - WIDTH + 1), 1)
    np.add.at(edge, np.minimum(n, centers + WIDTH), -1)
    return np.cumsum(edge[:n]) > 0


def _reach(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which shingles a stretch can hold that is similar to another one, given the filter of repeated min-hashes.

    Such stretches share a run of RUN shingles, whose minimum stands in both texts, and go WIDTH - RUN beyond it at most.
    """
    edge = np.zeros(len(values) + 1, np.int64)
    if len(values) >= RUN:
        at = np.flatnonzero(_inside(seen, _sliding(values, RUN, np.minimum)))
        np.add.at(edge, np.maximum(0, at - WIDTH + RUN), 1)
        np.add.at(edge, np.minimum(len(values), at + WIDTH), -1)
    return np.cumsum(edge[:-1]) > 0


def _between(found: np.ndarray, area: np.ndarray) -> np.ndarray:
    """Shingles of an area with the ones that follow and precede them, zero at the ends of a text."""
    around = np.r_[np.uint64(0), found, np.uint64(0)]
    return np.stack([found[area], around[2:][area], around[:-2][area]])


def _counted(near: list[np.ndarray], ends: bool = True) -> pa.RecordBatch:
    """How often each of some shingles stands there and, if ends are asked for, between which others."""
    values, *sides = np.concatenate(near, axis=1)
    order = np.argsort(values)
    values = values[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    columns = [pa.array(values[first].view(np.int64)), pa.array(np.diff(np.r_[first, len(values)]).astype(np.int64))]
    for side in sides if ends else ():
        low, high = (f.reduceat(side[order].view(np.int64), first) for f in (np.minimum, np.maximum))
        columns += [pa.array(low), pa.array(high, mask=low == high)]  # a maximum that is the minimum isn't written
    columns += [pa.nulls(len(first), pa.int64())] * (len(_SIDES) - len(columns))
    return pa.RecordBatch.from_arrays(columns, schema=_SIDES)


def _windows(repeated, frequent, ends: bool = True):
    """Compact windows of values that a few others may have, with codes of the shingles around their centers; and of
    each shingle near a window of a value that many have, how often it stands there and, if ends are asked for, between
    which others."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, often = repeated.value, frequent.value
        rows: list[tuple] = []
        near: list[np.ndarray] = []
        held = 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _WINDOW.types)], schema=_WINDOW)

        def counted() -> pa.RecordBatch:
            key, n, *sides = _counted(near, ends).columns
            none = pa.nulls(len(n), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), NEAR, np.int32)), key, n, pa.array(np.zeros(len(n), np.int32)), none, none, *sides], schema=_WINDOW)

        for node, found in _text_batches(batches):
            values = min_hash(found)
            centers = np.flatnonzero(minima(values))
            known = _inside(seen, values[centers])
            if not known.any():
                continue
            many = known & _inside(often, values[centers])
            if many.any():
                area = _area(len(found), centers[many]) & _reach(values, seen)
                near.append(_between(found, area))
                held += near[-1].shape[1]
            few = set(centers[known & ~many].tolist())
            if few:
                codes = (found >> np.uint64(48)).astype("<u2")
                for _, c, _ in compact_windows(values, centers):
                    if c in few:
                        after, before = codes[c : c + WIDTH], codes[max(0, c - WIDTH + 1) : c][::-1]
                        rows.append((FEW, int(values[c].view(np.int64)), node, c, after.tobytes(), before.tobytes(), None, None, None, None))
            if len(rows) > 20_000:
                yield sent()
                rows.clear()
            if held > 500_000:
                yield counted()
                near, held = [], 0
        if rows:
            yield sent()
        if near:
            yield counted()

    return find


def _repeated(common):
    """Rows whose first column, a key, is in the filter."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_inside(common.value, batch.column(0).to_numpy())))

    return find


def _parts(masked: np.ndarray, there: np.ndarray, forks: np.ndarray, joins: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, place, key of the stretch) of LEAST_SHARED shingles that may remain of a stretch after one edit.

    They are its beginning and its end around a gap, or the run it begins with. The shingle ahead of an edit is followed by another one
    in the other text, and the one behind it preceded by another, so only such places are cut.
    """
    n = len(masked)
    up, down = _POWERS.upto(n + 1)
    sums, holes = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.int64)
    np.cumsum(masked * up[:n], out=sums[1:])
    np.cumsum(~there, out=holes[1:])
    mixed = lambda x: (x ^ (x >> np.uint64(31))) * _MIX
    turns = masked[1:] != masked[:-1]
    for gap in GAPS:
        at = forks[: n - gap - 1] & joins[gap + 1 :]
        if gap < SHINGLE - 1:  # beside so few of its like that no shingle is followed by itself
            at &= turns[: n - gap - 1] & turns[gap:]
        cuts = np.flatnonzero(at) + 1
        low, high = np.searchsorted(starts, cuts - LEAST_SHARED + 1), np.searchsorted(starts, cuts)
        many = high - low
        if not many.sum():
            continue
        which = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        s, cut = starts[which], np.repeat(cuts, many)
        end = gap + s + LEAST_SHARED
        good = end <= n
        which, s, cut, end = which[good], s[good], cut[good], end[good]
        good = holes[cut] - holes[s] + holes[end] - holes[cut + gap] == 0
        which, s, cut, end = which[good], s[good], cut[good], end[good]
        yield mixed((sums[cut] - sums[s] + (sums[end] - sums[cut + gap]) * down[gap]) * down[s]), s, keys[which]
    for skip in range(WIDTH - LEAST_SHARED + 1):  # only at the end of a text does no stretch begin with a run
        which = np.flatnonzero((holes[starts + skip + LEAST_SHARED] == holes[starts + skip]) & ((skip == 0) | (starts == n - WIDTH)))
        at = starts[which] + skip
        yield mixed((sums[at + LEAST_SHARED] - sums[at]) * down[at]), at, keys[which]


def _stretches(found: np.ndarray, often: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(which shingles others may have, shingles without the others, starts, keys) of the stretches of WIDTH shingles
    near windows of many, if all but a few of their shingles stand near others too.

    A key leaves the other shingles out, so copies with an edit of their own at one place have one key.
    """
    values = min_hash(found)
    centers = np.flatnonzero(minima(values))
    centers = centers[_inside(often, values[centers])]
    if not len(centers):
        return None
    there = _area(len(found), centers)
    there[there] = _inside(common, found[there])
    starts = np.flatnonzero(_windowed(there) >= LEAST_SHARED)
    if not len(starts):
        return None
    masked = np.where(there, found, np.uint64(0))
    return there, masked, starts, stretch_hashes(masked, starts, starts + WIDTH)


def _blocks(frequent, shared):
    """Keys of the stretches that others may have too."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, found in _text_batches(batches):
            if (seen := _stretches(found, frequent.value, shared.value)) is not None:
                _, _, starts, keys = seen
                columns = [keys.view(np.int64), np.full(len(keys), node), starts.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "at"])

    return find


def _given(batches: Iterator[pa.RecordBatch], often: np.ndarray, common: np.ndarray) -> Iterator[tuple]:
    """(node, shingles, what _stretches() says of them) of (node, text, keys), for the stretches of these keys only."""
    for batch in batches:
        for (node, found), wanted in zip(_text_batches(iter([batch]), every=True), batch.column(2)):
            if (seen := _stretches(found, often, common)) is not None:
                there, masked, starts, keys = seen
                first = np.unique(keys, return_index=True)[1]
                first = np.sort(first[np.isin(keys[first].view(np.int64), wanted.values.to_numpy())])
                yield node, found, there, masked, starts[first], keys[first]


def _sides(frequent, shared):
    """Between which others the shingles of given stretches stand. Each content is given once, and two that differ by
    an edit have different shingles beside it, so this shows every place where an edit may have been."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: list[np.ndarray] = []
        held = 0
        for _, found, _, _, starts, _ in _given(batches, frequent.value, shared.value):
            edge = np.zeros(len(found) + 1, np.int64)
            edge[starts] += 1
            edge[starts + WIDTH] -= 1
            near.append(_between(found, np.cumsum(edge[:-1]) > 0))
            held += near[-1].shape[1]
            if held > 500_000:
                yield _counted(near)
                near, held = [], 0
        if held:
            yield _counted(near)

    # only what may stand twice is passed on; what the filter lets through besides has no fork
    return lambda batches: _repeated(shared)(counted(batches))


def _edits(frequent, shared, forking, joining):
    """Parts of the stretches of (node, text, keys) whose keys are given."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, found, there, masked, starts, keys in _given(batches, frequent.value, shared.value):
            forks, joins = there.copy(), there.copy()
            forks[there], joins[there] = _inside(forking.value, found[there]), _inside(joining.value, found[there])
            for part, place, key in _parts(masked, there, forks, joins, starts, keys):
                columns = [part.view(np.int64), key.view(np.int64), np.full(len(part), node), place.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "key", "node", "at"])

    return find


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links among the windows of each key, which come in order of their codes: all pairs of different codes;
    windows of equal codes are linked to the first of them."""
    names = ["a", "b", "a_start", "a_end", "b_start", "b_end"]
    firsts: list[tuple] = []
    key, out = None, []

    def add(other: int, there: int, node: int, at: int, back: int, run: int) -> None:
        out.append((other, node, there - back, there + run + SHINGLE - 1, at - back, at + run + SHINGLE - 1))

    for batch in batches:
        for k, node, at, after, before in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if k != key:
                key, firsts = k, []
            if firsts and firsts[-1][2] == after and firsts[-1][3] == before:
                if len(after) + len(before) >= 2 * WIDTH:
                    add(*firsts[-1][:2], node, at, len(before) // 2, len(after) // 2)
                continue
            mine = (node, at, after, before, Codes(after, before))
            for other in firsts:
                if found := same_passage(other[4], mine[4]):
                    add(*other[:2], node, at, *found)
            firsts.append(mine)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
            out.clear()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)


def passage_links(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges (a, b), spans (node, start, end)) of the repeated passages of (node, text), in words, end exclusive.

    The min-hash values of all compact windows are counted first. Windows of a value that up to PAIRWISE have meet in
    one task and are compared pair by pair. Windows of more frequent values, such as those of a line in every
    document, never do: of the stretches around them, those whose shingles stand around others too are grouped by
    content, and each distinct content is grouped by every part that may remain of it after one edit. Where an edit may
    be shows by the neighbours of shingles within distinct contents; outside, what texts share by chance can grow
    faster than they do, and none of it is passed on. Both are stars, linear in the windows, and lose no pair. Filters only clear values that certainly are of no interest: a value that
    a full filter takes for frequent goes the other way, which finds its pairs as well.
    """
    spark = nodes.sparkSession
    sent = lambda table: spark.sparkContext.broadcast(_filter(table, table.count()))
    slim = nodes.select("node", F.col("text").cast("binary").alias("text"))
    counts = materialize(slim.mapInArrow(_keys, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    repeated, frequent = sent(counts), sent(counts.filter(F.col("n") > PAIRWISE))

    windows = slim.mapInArrow(_windows(repeated, frequent, ends=False), _WINDOW_ROWS)
    found = materialize(windows.drop(*_ENDS), "windows")
    few = found.filter(F.col("kind") == FEW).select("key", "node", "at", "after", "before")
    link = "a long, b long, a_start long, a_end long, b_start long, b_end long"
    pairs = materialize(few.repartition("key").sortWithinPartitions("key", "after", "before", "node", "at").mapInArrow(_compare, link), "pairs")

    once = found.filter(F.col("kind") == NEAR)
    near = materialize(once.groupBy("key").agg(F.sum("node").alias("n")).filter("n > 1").select("key"), "near")
    shared = sent(near)
    for table in (found, near, counts):
        discard(table)
    blocks = materialize(slim.mapInArrow(_blocks(frequent, shared), "key long, node long, at int"), "blocks")
    sizes = materialize(blocks.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")), "sizes")
    # each content gives its neighbours and parts once, at its least node; only the texts of such nodes are shuffled
    givers = materialize(sizes.groupBy(F.col("least").alias("node")).agg(F.collect_list("key").alias("keys")), "givers")
    texts = split_by_bitmap(slim, membership_bitmap(givers, "node"), F.col("node")).filter("kf_maybe_").select("node", "text").join(givers, "node")
    texts = materialize(texts.select("node", "text", "keys"), "texts")
    ends = [f(F.coalesce(f"{c}_{e}", f"{c}_min")).alias(f"{c}_{e}") for c in ("next", "last") for e, f in (("min", F.min), ("max", F.max))]
    beside = texts.mapInArrow(_sides(frequent, shared), ", ".join(f"{x} long" for x in _SIDES.names))
    sides = materialize(beside.groupBy("key").agg(*ends).filter("next_min <> next_max OR last_min <> last_max"), "sides", texts=True)
    forking, joining = sent(sides.filter("next_min <> next_max")), sent(sides.filter("last_min <> last_max"))
    parts = materialize(texts.mapInArrow(_edits(frequent, shared, forking, joining), "part long, key long, node long, at int"), "parts", texts=True)
    for table in (sides, texts):
        discard(table)
    place = F.xxhash64("node", "at")
    groups = parts.groupBy("part").agg(F.min("node").alias("least"), F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    groups = materialize(groups.filter("first <> last").select("part", "least", "n"), "groups")
    alike = materialize(join_hot(parts, groups, "part", "inner").select("key", "node", "least").distinct(), "alike")
    discard(parts)
    known = materialize(sizes.join(alike.select("key", F.lit(True).alias("alike")).distinct(), "key", "left").filter("n > 1 OR alike").drop("alike"), "same")
    hits = materialize(join_hot(blocks, known, "key", "inner").select("node", "least", "at"), "hits")

    stars = hits.select(F.col("least").alias("a"), F.col("node").alias("b"))
    edges = pairs.select("a", "b").unionByName(stars).unionByName(alike.select(F.col("least").alias("a"), F.col("node").alias("b"))).distinct()
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("a_start").alias("start"), F.col("a_end").alias("end")), F.struct(F.col("b").alias("node"), F.col("b_start").alias("start"), F.col("b_end").alias("end")))
    spans = pairs.select(F.inline(ends)).unionByName(hits.select("node", F.col("at").cast("long").alias("start"), (F.col("at") + LEAST_WORDS).cast("long").alias("end")))
    # spans that begin within the length of a passage overlap, so each such stretch of a text needs one
    near_by = F.floor(F.col("start") / LEAST_WORDS)
    return edges, spans.groupBy("node", near_by.alias("part")).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def _merged(spans):
    """Sorted stretches, those that overlap or touch made one."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(F.coalesce(x["start"] <= last["end"], F.lit(False)), grown).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), none, step)


@tidy
def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_spans, n_words_repeated, spans) of the rows with a passage that stands elsewhere too.

    A passage has LEAST_WORDS words or more; near-duplicates reach SIMILARITY over shingles of SHINGLE words. spans are
    its places, array<struct<start, end>> in words, end exclusive; class_id is the smallest id that repeated
    passages reach. Texts equal without white space and case are one class: its least id is compared for all of
    them, and each is repeated as a whole. A passage repeated inside one text counts.

    Null and short texts have no passages. Rows that repeat an id count as one document; rows without an id take
    no part. An empty table gives no rows. Other columns aren't read.
    """
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    slim = materialize(raw.select("doc_id", F.xxhash64(F.lower(squeezed(F.col("text")))).alias("sig"), n_words.alias("words")), "slim")
    classes = materialize(slim.groupBy("sig").agg(F.min("doc_id").alias("least"), F.count_distinct("doc_id").alias("copies"), F.count("*").alias("n")), "classes")
    rows = materialize(join_hot(slim, classes, "sig", "inner").select("doc_id", "words", "least", "copies"), "rows")
    copies = materialize(rows.filter("doc_id <> least").select("doc_id").distinct(), "copies")
    texts = anti_join_ids(raw, copies, "doc_id")
    twice = materialize(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").join(copies, "doc_id", "left_anti").select("doc_id"), "twice")
    if not twice.isEmpty():  # rows that repeat id and text are one
        maybe = split_by_bitmap(raw, membership_bitmap(twice, "doc_id"), F.col("doc_id")).filter("kf_maybe_").select("doc_id", "text")
        texts = anti_join_ids(texts, twice, "doc_id").unionByName(maybe.join(twice, "doc_id", "left_semi").distinct())
    edges, spans = passage_links(texts.select(F.col("doc_id").alias("node"), "text"))

    roots = component_ids(edges)
    merged = spans.groupBy("node").agg(_merged(F.collect_list(F.struct("start", "end"))).alias("spans"))
    sizes = rows.groupBy(F.col("least").alias("node")).agg(F.count("*").alias("n"))
    known = sizes.join(roots, "node", "left").join(merged, "node", "left")
    known = materialize(known.select(F.col("node").alias("least"), "n", "component", "spans"), "known")
    out = join_hot(rows, known, "least", "left")
    whole = F.when((F.col("copies") > 1) & (F.col("words") >= LEAST_WORDS), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("words").alias("end"))))
    out = out.withColumn("spans", F.coalesce(whole, "spans")).filter("spans IS NOT NULL").dropDuplicates(["doc_id"])
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", F.coalesce("component", "least").alias("class_id"), F.size("spans").cast("long").alias("n_spans"), words.alias("n_words_repeated"), "spans")


def digest(found: DataFrame) -> DataFrame:
    """Spans as text."""
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ","))
