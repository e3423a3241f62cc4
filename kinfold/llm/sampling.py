"""Bounded samples of rows to fit models on, and bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, rows: int, chars: int, *columns: Column) -> list:
    """columns of at most ``rows`` rows of df, those whose values hash lowest; a pure function of df's content.

    The first column is text: rows are taken in the order of their hashes while their texts have at most ``chars``
    characters together. Hashes and lengths are ranked first and the rows fetched by a broadcast of their hashes, so
    no task or driver holds more.
    """
    picked = df.select(*columns)
    hashed = picked.withColumn("hash_", F.xxhash64(*picked.columns))
    ranked = hashed.groupBy("hash_").agg(F.max(F.char_length(picked.columns[0])).alias("size_")).orderBy("hash_").limit(rows)
    least, held = [], 0
    for h, size in ranked.collect():
        held += size or 0
        if held <= chars:
            least.append((h,))
    sent = df.sparkSession.createDataFrame(least, "hash_ long")
    return hashed.join(F.broadcast(sent), "hash_").dropDuplicates(["hash_"]).orderBy("hash_").drop("hash_").collect()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds Python objects of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
