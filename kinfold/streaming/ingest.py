"""Micro-batch ingestion: new note files, CSV drops or JSON drops become normalised fragments as they arrive.

An extension: the linkage itself stays a batch over the fragment table that this stream appends to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.functions.text import blocks, note_layout
from kinfold.operators.extract import extract_notes
from kinfold.plans.linkage import normalize


def stream_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming fragments (without fid) of whole note files dropped into folder."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    rows = files.select(F.explode(blocks(note_layout(F.col("value")))).alias("b"), F.col("_metadata.file_path").alias("path"))
    return extract_notes(rows.select(F.struct("path", "b.pos").alias("ord"), F.col("b.text").alias("raw_text")))


def append_fragments(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append normalised fragments to a Parquet table; each batch is written once, under its own number."""

    def write(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("fid", F.xxhash64(F.col("ord").cast("string"))).drop("ord")
        normalize(numbered).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
