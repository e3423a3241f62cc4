"""Readers of delimited files, applicant JSON and free-text notes, and the registry they are found by."""

from __future__ import annotations

import csv
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.functions.text import blocks, filled, note_layout


class SourceError(Exception):
    """A source that can't be read at all. Bad rows inside a source are skipped, not raised."""


class ConfigError(Exception):
    """An output configuration that can't be read or is invalid."""


def _decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where valid, else Latin-1. A byte-order mark stays."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each file."""
    try:
        files = spark.read.format("binaryFile").load(path)
        return files.select("path", _decoded(F.col("content")).alias("text"))
    except Exception as error:
        raise SourceError(f"can't read {path}: {error}") from error


def sniff_delimiter(sample: str) -> str:
    """The delimiter among , ; tab | that the first 4096 characters speak for; a comma if they don't."""
    try:
        return csv.Sniffer().sniff(sample[:4096], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(ord, cells map<header, value>) of a delimited file, each distinct row once, where it first stands.

    Headers are stripped and lower-cased; of equal headers the last counts. Values are stripped, blanks are null,
    surplus cells and blank rows are dropped. Delimiter and encoding are found from the head and the bytes. Without
    multi_line a large file is split over tasks, and no cell may hold a line break. A missing file raises
    SourceError; a blank one has no rows.
    """
    try:
        lines = spark.read.text(path)
        head = "\n".join(r[0] for r in lines.limit(64).collect())
    except Exception as error:
        raise SourceError(f"can't read {path}: {error}") from error
    empty = spark.createDataFrame([], "ord struct<file:string,at:long,row:long>, cells map<string,string>")
    if not head.strip():
        return empty
    sep = sniff_delimiter(head)
    latin = not lines.filter(~F.is_valid_utf8("value")).isEmpty()
    names = next(csv.reader(head.splitlines(), delimiter=sep))
    columns = [f"c{i}" for i in range(len(names))]
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("encoding", "ISO-8859-1" if latin else "UTF-8").option("mode", "PERMISSIVE").option("enforceSchema", True)
    raw = reader.schema(", ".join(f"{c} string" for c in columns)).csv(path)
    last = {name.strip().lower(): c for name, c in zip(names, columns) if name.strip()}
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    cells = F.map_from_arrays(F.array(*[F.lit(n) for n in last]), F.array(*[filled(F.col(c)) for c in last.values()]))
    rows = raw.select(at.alias("ord"), F.map_filter(cells, lambda k, v: v.isNotNull()).alias("cells")).filter(F.size("cells") > 0)
    return first_occurrences(rows, F.to_json("cells"))


def first_occurrences(rows: DataFrame, key: Column) -> DataFrame:
    """(ord, cells) with the first row of each key; equal rows are combined before the shuffle."""
    keyed = rows.groupBy(F.sha2(key, 256).alias("key")).agg(F.min(F.struct("ord", F.map_entries("cells").alias("cells"))).alias("first"))
    return keyed.select("first.ord", F.map_from_entries("first.cells").alias("cells"))


def read_ats(spark: SparkSession, path: str) -> DataFrame:
    """(ord, record variant) of the objects in applicant-system JSON files; text that isn't JSON has none.

    A file holds an array, an object with one of the known list keys, or one record with a telltale key.
    """
    # the parser stops behind a whole value; what follows it spoils either the list or the object around the text
    alone = [F.try_parse_json(F.concat(F.lit(a), "text", F.lit(b))) for a, b in (("[", "\n]"), ('{"v":', "\n}"))]
    only = alone[1].isNotNull() & (F.size(F.try_variant_get(alone[0], "$", "array<variant>")) == 1)
    whole = read_whole(spark, path).select("path", F.when(only, F.try_parse_json("text")).alias("v"))
    as_list = lambda p: F.try_variant_get("v", p, "array<variant>")
    kind = F.schema_of_variant("v")
    has = lambda k: F.try_variant_get("v", f"$.{k}", "variant").isNotNull()
    listed = F.coalesce(*[F.when(kind.startswith("OBJECT"), as_list(f"$.{k}")) for k in V.ATS_LIST_KEYS])
    single = F.when(kind.startswith("OBJECT") & (sum((has(k).cast("int") for k in V.ATS_SIGNAL_KEYS), F.lit(0)) > 0), F.array("v"))
    items = F.coalesce(F.when(kind.startswith("ARRAY"), as_list("$")), listed, single)
    rows = whole.select("path", F.posexplode(items).alias("pos", "record")).filter(F.schema_of_variant("record").startswith("OBJECT"))
    return rows.select(F.struct("path", "pos").alias("ord"), "record")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(ord, raw_text, block_index, source_file) of the blocks of note files."""
    found = read_whole(spark, path).select("path", F.explode(blocks(note_layout(F.col("text")))).alias("b"))
    return found.select(F.struct("path", "b.pos").alias("ord"), F.col("b.text").alias("raw_text"), F.col("b.pos").alias("block_index"), F.col("path").alias("source_file"))


#: Readers by source. A new source needs a reader here and an extractor in kinfold.operators.extract.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"csv": read_csv, "ats_json": read_ats, "recruiter_notes": read_notes}
