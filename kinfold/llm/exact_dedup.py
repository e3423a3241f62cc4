"""Exact dedup by per-partition counting quotient filters that merge losslessly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.runtime import anti_join_ids, join_hot, materialize, membership_bitmap, split_by_bitmap, tidy

#: Fingerprints a merged filter holds on average, 16 MB; the number of filters follows the input, from so many bits on.
PER_FILTER, LEAST_BITS = 1 << 21, 6


def squeezed(text: Column) -> Column:
    """Text without the characters [\\x20\\x09-\\x0D]; null counts as empty."""
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), " \t\n\x0b\f\r", F.coalesce(text, F.lit("")))


class CountingQuotientFilter:
    """Multiset of 64-bit fingerprints that share their first ``prefix_bits``.

    The next bits are the quotient, kept as one occupied bit a run plus run-end bits; the rest is the remainder, kept
    whole and sorted inside its run, so nothing is lost. There are as many quotient bits as the number of fingerprints
    has, so a filter's bytes are in proportion to them. Only counts above one take a counter.
    """

    def __init__(self, prefix: int, prefix_bits: int, values: np.ndarray, counts: np.ndarray):
        self.prefix, self.prefix_bits, self.values, self.counts = prefix, prefix_bits, values, counts

    @classmethod
    def build(cls, prefix: int, prefix_bits: int, fingerprints: np.ndarray) -> CountingQuotientFilter:
        return cls(prefix, prefix_bits, *np.unique(fingerprints.astype(np.uint64), return_counts=True))

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both are in order of quotient and remainder, so the stable sort below is one linear merge of two runs."""
        every = np.concatenate([self.values, other.values])
        order = np.argsort(every, kind="stable")
        every, counts = every[order], np.concatenate([self.counts, other.counts])[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
        return CountingQuotientFilter(self.prefix, self.prefix_bits, every[first], np.add.reduceat(counts, first) if len(first) else counts)

    @staticmethod
    def _split(n: int, prefix_bits: int) -> tuple[int, int, int]:
        """Bits of the quotient and of the remainder, and bytes of the remainder."""
        quotient = min(max(3, n.bit_length()), 64 - prefix_bits)
        rest = 64 - prefix_bits - quotient
        return quotient, rest, (rest + 7) // 8

    def to_bytes(self) -> bytes:
        bits, rest, width = self._split(len(self.values), self.prefix_bits)
        quotient = (self.values >> np.uint64(rest)).astype(np.int64) & ((1 << bits) - 1)
        occupied = np.zeros(1 << bits, bool)
        occupied[quotient] = True
        run_end = np.r_[quotient[1:] != quotient[:-1], True] if len(quotient) else np.zeros(0, bool)
        remainder = (self.values & np.uint64((1 << rest) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        many = self.counts > 1
        head = np.array([len(self.values), int(many.sum())], "<i8").tobytes()
        return b"".join([head, np.packbits(occupied).tobytes(), np.packbits(run_end).tobytes(), remainder.tobytes(), np.packbits(many).tobytes(), self.counts[many].astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, prefix: int, prefix_bits: int, blob: bytes) -> CountingQuotientFilter:
        self = cls(prefix, prefix_bits, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        n, k = (int(x) for x in np.frombuffer(blob, "<i8", 2))
        bits, rest, width = self._split(n, prefix_bits)
        at = 16
        raw = np.frombuffer(blob, np.uint8)
        take = lambda size: raw[at : at + size]
        occupied = np.unpackbits(take((1 << bits) // 8)).astype(bool)
        at += (1 << bits) // 8
        run_end = np.unpackbits(take((n + 7) // 8), count=n).astype(np.int64)
        at += (n + 7) // 8
        remainder = np.zeros((n, 8), np.uint8)
        remainder[:, :width] = take(n * width).reshape(n, width)
        at += n * width
        many = np.unpackbits(take((n + 7) // 8), count=n).astype(bool)
        at += (n + 7) // 8
        self.counts = np.ones(n, np.int64)
        self.counts[many] = np.frombuffer(blob, "<i8", k, at)
        run = np.cumsum(run_end) - run_end
        quotient = np.flatnonzero(occupied)[run].astype(np.uint64)
        high = np.uint64(prefix << (64 - prefix_bits)) if prefix_bits else np.uint64(0)
        self.values = high | (quotient << np.uint64(rest)) | remainder.view("<u8").reshape(-1)
        return self


def duplicate_fingerprints(keys: DataFrame, fp: str, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once. keys: a written table; rows: its row count."""
    bits = max(LEAST_BITS, (max(rows, 1) // PER_FILTER).bit_length())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches if b.num_rows]
        every = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        cuts = np.searchsorted(every, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        parts = [(i, part) for i, part in enumerate(np.split(every, cuts[1:])) if len(part)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([CountingQuotientFilter.build(i, bits, p).to_bytes() for i, p in parts], pa.binary())], ["range", "filter"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        filters = [CountingQuotientFilter.from_bytes(key[0].as_py(), bits, x) for x in table.column("filter").to_pylist()]
        while len(filters) > 1:
            filters = [a.merge(b) for a, b in zip(filters[::2], filters[1::2])] + filters[len(filters) & ~1 :]
        many = filters[0].counts > 1
        return pa.table({"fp": pa.array(filters[0].values[many].view(np.int64)), "n": pa.array(filters[0].counts[many])})

    return keys.select(fp).mapInArrow(build, "range int, filter binary").groupBy("range").applyInArrow(merge, "fp long, n long")


@tidy
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are after removing white space; the longest original stays, then the smallest
    id, then one row of several that repeat an id. Null text counts as empty; a null id stays only where no other
    row of its group is as long. Only the id and the text column are read, so other columns may have any names.

    Fingerprints of all rows go through the quotient filters; those with a count above one go on to the byte
    check, where the texts themselves are compared by grouping on them (combined before the shuffle, so a hot
    text moves once a task). A 4 MB bitmap of those fingerprints keeps other texts out of that shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = squeezed(F.col(text_col))
    keys = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).alias("chars"), norm.alias("norm"))
    keys = keys.select("doc_id", "chars", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("row"))
    keys = materialize(keys, "keys")
    rows = keys.count()
    dup = materialize(duplicate_fingerprints(keys, "fp", rows), "dup")

    texts = docs.select(norm.alias("norm")).withColumn("fp", F.xxhash64("norm"))
    texts = split_by_bitmap(texts, membership_bitmap(dup, "fp"), F.col("fp")).filter("kf_maybe_")
    same = texts.groupBy("norm").agg(F.count("*").alias("n")).filter("n > 1").select(F.sha2("norm", 256).alias("sha"), "n")
    same = materialize(same, "same")

    among = join_hot(keys, dup, "fp", "inner", total=rows)
    best = among.groupBy("sha").agg(F.max(F.struct("chars", (-F.col("doc_id")).alias("o"), (-F.col("row")).alias("r"), "doc_id")).alias("best"))
    best = materialize(best.join(same, "sha").select("sha", F.col("best.doc_id").alias("keep_id"), (-F.col("best.r")).alias("keep_row"), "n"), "best")
    out = join_hot(keys, best, "sha", "left", total=rows)
    alone = F.col("n").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


@tidy
def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops. Rows that repeat an id stay or go together; null ids stay."""
    verdict = exact_dedup(docs, id_col, text_col).groupBy(F.col("doc_id").alias(id_col)).agg(F.max("kept").alias("kept"))
    return anti_join_ids(docs, materialize(verdict.filter("not kept").select(id_col), "gone"), id_col)
