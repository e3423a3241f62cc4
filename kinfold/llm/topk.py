"""Exact inner-product top-k over a bit-sliced index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.runtime import materialize, tidy

#: Components become floor(SCALE * x).
SCALE = 1024
#: Rows of one index block, and queries that are worked on at once.
INDEX_ROWS, QUERY_ROWS = 16384, 256
#: Slices kept of each attribute, from the most significant down. The rest only widens the boundary.
KEPT_SLICES = 8
#: Components and sums below this are worked out in machine integers, others in Python's.
_SMALL = 1 << 62


def sound_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, v array<double>) of the rows that take part; row deals rows of one id over the blocks too."""
    sound = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(sound).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """floor(SCALE * x) as integers, exactly: int64, or Python's where a component is too large for that."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, most = column.flatten().to_numpy(zero_copy_only=False), max(width, int(lengths.max(initial=0)))
    small = np.abs(flat).max(initial=0.0) * SCALE < _SMALL
    whole = np.floor(flat * SCALE).astype(np.int64) if small else np.array([int(math.floor(x * SCALE)) if abs(x) < 2.0**53 else int(x) * SCALE for x in flat.tolist()], object)
    out = np.zeros((len(lengths), most), whole.dtype)
    out[np.arange(most) < lengths[:, None]] = whole
    return out


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products without wrapping."""
    if rows.dtype == query.dtype == np.int64:
        if len(rows) == 0 or int(np.abs(rows).max(initial=0)) * sum(abs(x) for x in query.tolist()) < _SMALL:
            return rows @ query
    found = rows.astype(object) @ query.astype(object)
    return np.asarray(found, object)


class BitSlicedIndex:
    """Attributes of a block of rows as bitmaps: slice i of attribute d has a bit for each row."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        n, dims = rows.shape
        if n and rows.dtype == np.int64 and int(np.abs(rows).max(initial=0)) >= _SMALL >> 1:
            rows = rows.astype(object)  # differences could wrap
        shifted = rows - rows.min(axis=0) if n else rows
        self.bits = max(1, int(shifted.max(initial=0)).bit_length())
        self.dropped = max(0, self.bits - KEPT_SLICES)
        words = -(-n // 64)
        kept = self.bits - self.dropped
        # [0]: slices of the attribute; [1]: of its complement, for negative weights
        self.slices = np.zeros((2, dims, kept, words), np.uint64)
        for i in range(kept):
            on = ((shifted >> (i + self.dropped)) & 1).astype(np.uint8).T
            packed = np.zeros((dims, words * 8), np.uint8)
            packed[:, : -(-n // 8)] = np.packbits(on, axis=1, bitorder="little")
            self.slices[0, :, i] = packed.view(np.uint64)
        self.slices[1] = ~self.slices[0]
        full = np.zeros(words * 8, np.uint8)
        full[: -(-n // 8)] = np.packbits(np.ones(n, np.uint8), bitorder="little")
        self.all = full.view(np.uint64)

    def weighted_sum(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices of the sum over attributes of |weight| times the attribute or, for negative weights, its complement.

        Shifting a slice multiplies it, so every set bit of a weight puts the attribute's slices into columns of
        equal value; carry-save adders over bitmaps then leave one slice a column.
        """
        kept = self.slices.shape[2]
        size, sign = np.abs(weights), (weights < 0).astype(np.int64)
        columns: list[list[np.ndarray]] = []
        for j in range(int(size.max(initial=0)).bit_length()):
            dims = np.flatnonzero((size >> j) & 1)
            for i in range(kept):
                while len(columns) <= i + j:
                    columns.append([])
                if len(dims):
                    columns[i + j].append(self.slices[sign[dims], dims, i])
        total: list[np.ndarray] = []
        at = 0
        while at < len(columns):
            stack = np.concatenate(columns[at]) if columns[at] else np.zeros((1, len(self.all)), np.uint64)
            while len(stack) > 1:
                third = len(stack) // 3
                if third:
                    a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                    odd = a ^ b
                    carry, added, rest = (a & b) | (odd & c), odd ^ c, stack[3 * third :]
                else:
                    a, b = stack[:1], stack[1:2]
                    carry, added, rest = a & b, a ^ b, stack[2:]
                if at + 1 == len(columns):
                    columns.append([])
                columns[at + 1].append(carry)
                stack = np.concatenate([added, rest])
            total.append(stack[0] & self.all)
            at += 1
        return total

    def boundary(self, weights: np.ndarray, k: int) -> np.ndarray:
        """Positions of all rows that can be among the k best; the others are proven worse."""
        n = len(self.rows)
        if n <= k:
            return np.arange(n)
        total = self.weighted_sum(weights)
        sure, open_, kth = np.zeros_like(self.all), self.all.copy(), 0
        for p in range(len(total) - 1, -1, -1):  # from the most significant slice downward
            high = open_ & total[p]
            if int(np.bitwise_count(sure | high).sum()) >= k:
                open_, kth = high, kth | (1 << p)
            else:
                sure, open_ = sure | high, open_ & ~total[p]
        # dropped slices add between zero and this many units to a row's sum
        slack = -(-sum(abs(x) for x in weights.tolist()) * ((1 << self.dropped) - 1) // (1 << self.dropped))
        least = max(0, kth - slack)
        above, level = np.zeros_like(self.all), self.all.copy()
        for p in range(max(len(total), least.bit_length()) - 1, -1, -1):
            slice_ = total[p] if p < len(total) else np.zeros_like(self.all)
            if (least >> p) & 1:
                level = level & slice_
            else:
                above, level = above | (level & slice_), level & ~slice_
        return np.flatnonzero(np.unpackbits((above | level).view(np.uint8), count=n, bitorder="little"))


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.int32()), ("wide", pa.binary())])
_FOUND_ROWS = "query_id long, vec_id long, score long, beyond int, wide binary"


def _wide(score: int) -> tuple[int | None, int, bytes | None]:
    """(score, beyond, wide): a score that no long holds is null; beyond and wide order such scores."""
    if -(1 << 63) <= score < 1 << 63:
        return score, 0, None
    return None, 1 if score > 0 else -1, (score + (1 << 4095)).to_bytes(512, "big")


def _search(k: int):
    """Blocks of rows, each followed by its queries: the index of a block is built once and queries stream by."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, index = None, [], None
        for batch in batches:
            cells, is_query = batch.column("cell").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
                if a == b:
                    continue
                if cells[a] != cell:
                    cell, held, index = cells[a], [], None
                part = batch.slice(a, b - a)
                if not is_query[a]:
                    held.append(part)
                    continue
                if held:
                    table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    rows, ids = _matrix(table.column("v")), table.column("vec_id").to_numpy()
                    held, index = [], BitSlicedIndex(rows)
                if index is None:  # a block without rows
                    continue
                for at in range(0, part.num_rows, QUERY_ROWS):
                    yield answers(part.slice(at, QUERY_ROWS), index, ids)

    def answers(asked: pa.RecordBatch, index: BitSlicedIndex, ids: np.ndarray) -> pa.RecordBatch:
        queries, width = _matrix(asked.column("v")), index.rows.shape[1]
        queries = np.pad(queries, ((0, 0), (0, max(0, width - queries.shape[1]))))[:, :width]  # beyond, rows count as zero
        out: list[tuple] = []
        for qid, query in zip(asked.column("vec_id").to_pylist(), queries):
            at = index.boundary(query, k + int((ids == qid).sum()))
            at = at[ids[at] != qid]
            scores = exact_scores(index.rows[at], query).tolist()
            for i in sorted(range(len(at)), key=lambda i: (-scores[i], ids[at[i]]))[:k]:
                out.append((qid, int(ids[at[i]]), *_wide(scores[i])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FOUND.types)] if out else [pa.array([], t) for t in _FOUND.types], schema=_FOUND)

    return search


@tidy
def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    is_query picks the queries among the columns of (vec_id, v); every row of another id is a candidate. Blocks of rows
    are indexed by bit slices, once each, and all queries stream past; for each, slices are added by bitmap arithmetic,
    the most significant ones are descended to the k-th sum, and the rows that the dropped slices leave open are scored
    exactly. Only where there are fewer blocks than tasks, copies of a block share its queries out.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids. Missing components
    of shorter vectors count as zero. Rows that repeat an id are candidates each; as queries they are ranked together.
    Integers of any size are exact; a score that doesn't fit a
    long is null, at its right rank. Fewer than k candidates: all of them. No queries or an empty table: no rows. Other
    columns aren't read.
    """
    spark = df.sparkSession
    vectors = materialize(sound_vectors(df, id_col, vector_col), "vectors")
    queries = vectors.filter(is_query)
    blocks = -(-vectors.count() // INDEX_ROWS) or 1
    shares = max(1, min(-(-queries.count() // QUERY_ROWS), -(-2 * spark.sparkContext.defaultParallelism // blocks)))
    cut = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = [
        vectors.select("row", "vec_id", "v", F.lit(False).alias("is_query"), cut(blocks).alias("block"), spread(shares).alias("share")),
        queries.select("row", "vec_id", "v", F.lit(True).alias("is_query"), spread(blocks).alias("block"), cut(shares).alias("share")),
    ]
    both = cells[0].unionByName(cells[1]).select("row", "vec_id", "v", "is_query", (F.col("block") * shares + F.col("share")).alias("cell"))
    found = both.repartition(blocks * shares, "cell").sortWithinPartitions("cell", "is_query").mapInArrow(_search(k), _FOUND_ROWS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), F.desc("wide"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
