"""Conflict-constrained best-fit packing of documents into training sequences."""

from __future__ import annotations

from functools import reduce
from heapq import heappop, heappush
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.exact_dedup import squeezed
from kinfold.runtime import materialize, tidy

#: Words a bin holds.
CAPACITY = 2048
#: Documents packed together on average. Groups are drawn by hash, so a hot source is spread over all of them.
PER_GROUP = 4096


class Bins:
    """Open bins in order of residual capacity, each with a bitmap of the sources and duplicate clusters in it.

    A search tree over residuals keeps in each node the AND of the bitmaps below. If an item's bits meet that AND,
    every bin below conflicts and the successor search passes over the subtree.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.common = [-1] * (2 * self.size)  # -1: no bins, which conflicts with any item
        self.at: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.capacity, self.opened = capacity, 0

    def _refresh(self, residual: int) -> None:
        node, keys = residual + self.size, self.at[residual]
        self.common[node] = reduce(and_, keys) if keys else -1
        node >>= 1
        while node:
            both = self.common[2 * node] & self.common[2 * node + 1]
            if self.common[node] == both:
                break
            self.common[node] = both
            node >>= 1

    def _next(self, node: int, mask: int) -> int:
        """The first leaf at or after node whose bins don't all conflict; 0 if none."""
        common, size = self.common, self.size
        while True:
            if not common[node] & mask:
                if node >= size:
                    return node
                node *= 2
                continue
            while node & 1:
                node >>= 1
            if not node:
                return 0
            node += 1

    def place(self, length: int, mask: int) -> tuple[int, int]:
        """(bin, offset): the tightest bin that holds length and shares no bit with mask, of equally tight ones the one
        opened first, else a new one."""
        item = mask | 1  # no bin has bit 0, the mark of a leaf without bins
        node = self._next(length + self.size, item)
        while node:
            residual = node - self.size
            keys = self.at[residual]
            bits = min((b for b in keys if not b & mask), key=lambda b: keys[b][0], default=None)
            if bits is not None:
                chosen = heappop(keys[bits])
                if not keys[bits]:
                    del keys[bits]
                self._refresh(residual)
                break
            while node & 1:  # go on behind this leaf
                node >>= 1
            node = self._next(node + 1, item) if node else 0
        else:
            chosen, bits, residual = self.opened, 0, self.capacity
            self.opened += 1
        left = residual - length
        heappush(self.at[left].setdefault(bits | mask, []), chosen)
        self._refresh(left)
        return chosen, self.capacity - residual


def pack_items(items: list[tuple], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(item position, piece, bin, offset, start, length) for items (length, source, cluster).

    Items beyond the capacity fill bins of their own with whole pieces; what remains of them, and every other item,
    goes largest first to its tightest compatible bin. Null sources and clusters conflict with nothing.
    """
    names: dict[tuple[str, object], int] = {}
    several: set = set()
    seen: set = set()
    for _, _, cluster in items:
        (several if cluster in seen else seen).add(cluster)
    bins, out, rest = Bins(capacity), [], []
    for i, (length, source, cluster) in enumerate(items):
        whole = max(0, -(-length // capacity) - 1)
        mask = 0
        if source is not None:
            mask |= 2 << names.setdefault(("s", source), len(names))
        if cluster is not None and cluster in several:
            mask |= 2 << names.setdefault(("c", cluster), len(names))
        rest.append((length - whole * capacity, i, whole, mask))
        for piece in range(whole):
            out.append((i, piece, bins.opened, 0, piece * capacity, capacity))
            bins.opened += 1
    for length, i, piece, mask in sorted(rest, key=lambda r: (-r[0], r[1])):
        where, offset = bins.place(length, mask)
        out.append((i, piece, where, offset, piece * capacity, length))
    return out


@tidy
def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, piece, bin_id, bin_offset, start_word, n_words): where each stretch of each document goes.

    No bin holds two documents of one source or of one duplicate cluster (equal texts without white space). A
    document longer than a bin is cut into whole bins and a remainder. Every row of docs is packed, repeated rows
    and null ids too; null and wordless texts take no room; a null source conflicts with nothing. Each group of
    about PER_GROUP documents has bins of its own; hot sources and clusters are spread evenly over groups. Only
    lengths and keys are shuffled, not texts. Other columns aren't read.
    """
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.col(source_col).cast("string").alias("source"),
        F.xxhash64(squeezed(F.col(text_col))).alias("cluster"),
        F.monotonically_increasing_id().alias("row"),
    )
    slim = materialize(slim, "lengths")
    groups = max(1, -(-slim.count() // PER_GROUP))
    # the row's place deals out rows of one id and text, however many there are
    slim = slim.withColumn("part", F.pmod(F.xxhash64("doc_id", "cluster", "row"), F.lit(groups)))

    def one(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["words", "doc_id", "source", "cluster"]).to_pylist(), key=lambda r: (-r["words"], r["doc_id"] is None, r["doc_id"] or 0, r["cluster"], r["source"] or ""))
        first = key[0].as_py() << 32
        found = pack_items([(r["words"], r["source"], r["cluster"]) for r in rows], capacity)
        columns = list(zip(*[(rows[i]["doc_id"], piece, first + where, offset, start, n) for i, piece, where, offset, start, n in found])) or [()] * 6
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(["doc_id", "piece", "bin_id", "bin_offset", "start_word", "n_words"], columns)})

    return slim.groupBy("part").applyInArrow(one, "doc_id long, piece long, bin_id long, bin_offset long, start_word long, n_words long")
