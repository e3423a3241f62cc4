"""SimHash near-duplicates: pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.sampling import slices
from kinfold.operators.components import components
from kinfold.runtime import anti_join_ids, join_hot, materialize, membership_bitmap, split_by_bitmap, tidy

#: Fingerprints link at this many differing bits or fewer.
MAX_BITS = 2
#: Widths of the blocks a fingerprint is split into; MAX_BITS of them can differ, so three of five agree.
BLOCKS = (13, 13, 13, 13, 12)
#: Buckets of up to this many distinct fingerprints are compared pair by pair, larger ones by shared neighbours.
PAIRWISE = 16
SEED = 42
#: Of near-duplicates beyond fingerprints: words of a shingle, least similarity, bands, and min-hashes of a band. A pair
#: of that similarity shares no band with probability (1 - 0.8 ** 2) ** 10, four in 100,000.
NEAR_WIDTH, NEAR_SIMILARITY, BANDS, BAND_ROWS = 5, 0.8, 10, 2
#: Texts of a large band that all others of it are compared with.
LEADS = 4
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BAND_SEEDS = np.array([xxhash.xxh64_intdigest(b"band", i) for i in range(BANDS * BAND_ROWS)], np.uint64)
_LANES = np.uint64(0x0101010101010101)


def bit_majority(hashes: np.ndarray) -> int:
    """The 64-bit number with a bit set where over half the hashes have it set."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for shift in range(8):
        lanes = (hashes >> np.uint64(shift)) & _LANES
        # eight byte-wide counters to a word; 255 words can't overflow one
        sums = np.add.reduceat(lanes, np.arange(0, n, 255)).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        ones[shift::8] = sums
    return int(np.bitwise_or.reduce(np.where(2 * ones > n, np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0))))


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of UTF-8 text over its word shingles, repeats included; no words: zero."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts, (ends - 1).tolist()[width - 1 :])
    return bit_majority(np.array([digest(joined[a:b], SEED) for a, b in cuts], np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row; null text has no words."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(_fingerprints, "doc_id long, fp long")


def _masks() -> list[int]:
    cuts = np.cumsum((0,) + BLOCKS)
    whole = [((1 << BLOCKS[i]) - 1) << int(cuts[i]) for i in range(len(BLOCKS))]
    masks = [sum(whole[i] for i in kept) for kept in combinations(range(len(BLOCKS)), len(BLOCKS) - MAX_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_pairs(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join exactly those MAX_BITS apart or less into components.

    Each fingerprint goes to one bucket for every choice of three blocks. In a small bucket all pairs are compared.
    Members of a larger one instead name the 65 values at most one bit away: two fingerprints are two bits apart or
    less exactly if they name a value in common, and no value is named by more than 65. So a large group costs a
    constant for each member, and no link is lost.
    """
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks())])
    keyed = fps.select("fp", F.inline(tables))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = materialize(keyed.join(sizes, ["t", "key"]).select("t", "key", "fp", "size"), "blocks")

    small = shared.filter(F.col("size") <= PAIRWISE)
    a, b = small.select("t", "key", F.col("fp").alias("a")), small.select("t", "key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    pairs = a.join(b, (a.t == b.t) & (a.key == b.key) & near).select("a", "b")

    flips = [0] + [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    around = F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips]))
    large = shared.filter(F.col("size") > PAIRWISE).select("fp").distinct()
    named = large.select("fp", around.alias("value")).groupBy("value").agg(F.sort_array(F.collect_list("fp")).alias("members"))
    stars = named.filter(F.size("members") > 1).select(F.col("members")[0].alias("a"), F.explode("members").alias("b")).filter("a <> b")
    return pairs.unionByName(stars).distinct()


@tidy
def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Rows of equal fingerprint are one node. Null or wordless text has fingerprint zero and links like any other.
    A null id takes part and never is the smallest; a component of null ids only has a null component_id. An empty
    table gives no rows. Other columns aren't read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(materialize(close_pairs(nodes.select("fp")), "pairs"))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", F.xxhash64("fp")).alias("root"))
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "least")
    known = materialize(join_hot(rooted, least, "root", "inner", n="m").select("fp", "n", "component_id"), "known")
    out = join_hot(rows, known, "fp", "inner")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, doc_id, fp, size, bands, hashes): hash of the words, SimHash, distinct shingles, bands of min-hashes, and
    the shingles' hashes in order. Texts without words have no bands."""
    for batch in slices(batches, 256):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(LOWER).split()
            joined, width = b" ".join(words), min(NEAR_WIDTH, len(words))
            ends = np.cumsum([len(w) + 1 for w in words]).tolist()
            found = np.array([xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip([0, *ends[:-1]], [e - 1 for e in ends[width - 1 :]])] if words else [], np.uint64)
            every, bands = np.unique(found), []
            if len(every):
                mixed = (every[None] ^ _BAND_SEEDS[:, None]) * np.uint64(0xFF51AFD7ED558CCD)
                least = (mixed ^ (mixed >> np.uint64(32))).min(axis=1).reshape(BANDS, -1)
                bands = [xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(least)]
            fp = bit_majority(found) if len(found) else 0
            rows.append((xxhash.xxh64_intdigest(joined) - (1 << 63), doc_id, fp - (fp >> 63 << 64), len(every), bands, np.unique((every >> np.uint64(32)).astype("<u4")).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SKETCH.types)] if rows else [pa.array([], t) for t in _SKETCH.types], schema=_SKETCH)


_SKETCH = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("size", pa.int32()), ("bands", pa.list_(pa.int64())), ("hashes", pa.binary())])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs whose shingles reach NEAR_SIMILARITY."""
    for batch in slices(batches):
        good = []
        for i, (p, q) in enumerate(zip(batch.column(2), batch.column(3))):
            p, q = (np.frombuffer(x.as_buffer(), "<u4") for x in (p, q))
            both = len(np.intersect1d(p, q, assume_unique=True))
            if both >= NEAR_SIMILARITY * (len(p) + len(q) - both):
                good.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(good, pa.int64())) for i in (0, 1)], ["a", "b"])


def _sets_of(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, size, hashes), one row for each node of wanted, a written table; only the sets of these are shuffled."""
    sets = split_by_bitmap(rows.select("node", "size", "hashes"), membership_bitmap(wanted, "node"), F.col("node")).filter("kf_maybe_").drop("kf_maybe_")
    return sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The similar ones among distinct pairs (a, b) of nodes, a written table. Sizes that differ too much rule out.

    rows: (node, size, hashes), a written table. Only the sets of nodes in pairs are shuffled.
    """
    paired = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "paired")
    sets = materialize(_sets_of(paired, rows), "sets")
    for side in ("a", "b"):
        n = pairs.groupBy(side).agg(F.count("*").alias("n"))
        known = materialize(sets.withColumnRenamed("node", side).join(n, side).select(side, F.col("size").alias(f"{side}_size"), F.col("hashes").alias(f"{side}_hashes"), "n"), f"sets_{side}")
        pairs = join_hot(pairs, known, side, "inner").drop("n")
        if side == "a":
            pairs = materialize(pairs, "half")
    alike = F.least("a_size", "b_size") >= F.lit(NEAR_SIMILARITY) * F.greatest("a_size", "b_size")
    return materialize(pairs.filter(alike).select("a", "b", "a_hashes", "b_hashes").mapInArrow(_similar, "a long, b long"), "similar")


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, n, least, most): how many of some (root, hashes) have a shingle, and their least and largest root."""
    for batch in slices(batches, 1024):
        sets = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column(1)]
        if not sets:
            continue
        found, root = np.concatenate(sets), np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
        order = np.argsort(found, kind="stable")
        found, root = found[order], root[order]
        first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        columns = [found[first], np.diff(np.r_[first, len(found)]), np.minimum.reduceat(root, first), np.maximum.reduceat(root, first)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "n", "least", "most"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root, size, shingle) of (node, root, hashes)."""
    for batch in slices(batches, 1024):
        sets = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column(2)]
        if sets:
            sizes = np.array([len(x) for x in sets], np.int32)
            columns = [np.repeat(c, sizes) for c in (batch.column(0).to_numpy(), batch.column(1).to_numpy(), sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, np.concatenate(sets))], ["node", "root", "size", "shingle"])


def across_components(texts: DataFrame, roots: DataFrame, rows: DataFrame) -> DataFrame:
    """Every similar pair (a, b) of the nodes of texts, a written table, whose roots differ; nodes not in roots are alone.

    A prefix filter, which loses none. Shingles are ordered: first those that stand in texts of one component only,
    which no such pair shares, then the others, the rare ones first. Two similar sets share a shingle among the first
    1 - NEAR_SIMILARITY of each, and what follows the first that they share bounds what they share. So texts told
    apart by enough shingles of their own, such as those that only a line in common brings into one band, meet nobody.
    """
    rooted = _sets_of(texts, rows).join(roots, "node", "left").select("node", F.coalesce("root", F.xxhash64("node")).alias("root"), "hashes")
    sets = materialize(rooted, "rooted")
    counts = sets.select("root", "hashes").mapInArrow(_shingle_counts, "shingle int, n long, least long, most long")
    counts = counts.groupBy("shingle").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    common = materialize(counts.filter("least < most").select("shingle", "n"), "common")

    every = sets.mapInArrow(_shingles, "node long, root long, size int, shingle int")
    every = split_by_bitmap(every, membership_bitmap(common, "shingle"), F.col("shingle")).filter("kf_maybe_").drop("kf_maybe_")
    held = join_hot(materialize(every, "shingles"), common, "shingle", "inner").groupBy("node", "root", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("order"))
    own = F.col("size") - F.size("order")
    left = (F.col("size") - F.ceil(F.lit(NEAR_SIMILARITY) * F.col("size")) + 1 - own).cast("int")
    prefix = held.select("node", "root", "size", own.alias("own"), F.posexplode(F.slice("order", 1, F.greatest(left, F.lit(0)))))
    prefix = materialize(prefix.select("node", "root", "size", F.col("col.shingle").alias("shingle"), (F.col("size") - F.col("own") - F.col("pos")).alias("after")), "prefix")

    side = lambda c: prefix.select("shingle", F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("root", "size", "after")])
    most, both = F.least("a_after", "b_after"), F.col("a_size") + F.col("b_size")
    near = side("a").join(side("b"), "shingle").filter((F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & (most >= F.lit(NEAR_SIMILARITY) * (both - most)))
    return _verified(materialize(near.select("a", "b").distinct(), "across"), rows)


def near_edges(sketches: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges (a, b) between similar texts, from sketches (node, fp, bands), one row a node, and rows (node, size, hashes).

    Candidates are fingerprints MAX_BITS apart or less and texts that share a band. Bands of up to PAIRWISE texts are
    compared pair by pair. In a larger one all are compared with LEADS of it: of each share, drawn anew in every band,
    the text whose bands most texts have, since that is what edited copies have in common. That joins most of a group
    of copies with linear work; across_components finds the links of large bands that it leaves, so none is lost.
    """
    keyed = materialize(sketches.select("node", F.explode("bands").alias("band")), "bands")
    sizes = keyed.groupBy("band").agg(F.count("*").alias("n"))
    rest = materialize(join_hot(keyed, materialize(sizes.filter("n > 1"), "sizes"), "band", "inner"), "rest")
    few, many = rest.filter(F.col("n") <= PAIRWISE), rest.filter(F.col("n") > PAIRWISE)
    one, two = few.select("band", F.col("node").alias("a")), few.select("band", F.col("node").alias("b"))
    pairs = one.join(two, "band").filter("a < b").select("a", "b")

    spread = materialize(many.groupBy("node").agg(F.sum("n").alias("spread")), "spread")
    known = many.select("band", "node").join(spread, "node")
    leads = known.groupBy("band", F.pmod(F.xxhash64("node", "band"), F.lit(LEADS)).alias("share")).agg(F.max(F.struct("spread", "node"))["node"].alias("lead"), F.count("*").alias("n"))
    leads = leads.groupBy("band").agg(F.collect_list("lead").alias("leads"), F.sum("n").alias("n"))
    met = join_hot(many.drop("n"), materialize(leads, "leads"), "band", "inner").select("node", F.explode("leads").alias("lead"))
    pairs = pairs.unionByName(met.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")))

    fps = materialize(sketches.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "fps")
    named = lambda c: fps.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node"))
    close = close_pairs(fps.select("fp")).join(named("a"), "a").join(named("b"), "b").select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    same = join_hot(sketches.select("node", "fp"), fps.filter("n > 1"), "fp", "inner").select(F.col("least").alias("a"), F.col("node").alias("b"))
    first = _verified(materialize(pairs.unionByName(close).unionByName(same).filter("a <> b").distinct(), "pairs"), rows)
    if spread.isEmpty():
        return first
    return first.unionByName(across_components(spread.select("node"), components(first), rows))


@tidy
def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, component_id (smallest id reachable) over links of similar texts.

    Texts are similar if their sets of NEAR_WIDTH-word shingles (A-Z lower-cased; fewer words: the whole sequence) reach
    a Jaccard similarity of NEAR_SIMILARITY; texts without words are equal. SimHash fingerprints that far apart differ
    in ten of 64 bits on average, beyond any blocks that agree; so bands of min-hashes add the candidates that the
    fingerprints can't, and every pair is verified on the sets. Of large groups see near_edges. A null id takes part and never is the smallest. Other
    columns aren't read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = materialize(slim.mapInArrow(_sketches, "node long, doc_id long, fp long, size int, bands array<long>, hashes binary"), "rows", texts=True)
    sketches = materialize(rows.filter("size > 0").select("node", "fp", "bands").distinct(), "sketches")
    roots = components(near_edges(sketches, rows))
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    rooted = materialize(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", F.xxhash64("node"))), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "least")
    known = materialize(join_hot(rooted, least, "root", "inner", n="m").select("node", "n", "component_id"), "known")
    return join_hot(rows.select("node", "doc_id"), known, "node", "inner").select("doc_id", "component_id")


@tidy
def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component of similar texts, that of the smallest id; null ids stay."""
    found = near_components(docs, id_col, text_col)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return anti_join_ids(docs, materialize(gone, "gone"), id_col)
