"""Sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def write_json_lines(df: DataFrame, path: str, column: str = "json") -> None:
    """One JSON object a line, distributed."""
    df.select(column).write.mode("overwrite").text(path)


def pretty_json(df: DataFrame, column: str = "json", order_by: str | None = "candidate_id", ascii_only: bool = False) -> str:
    """A small result as one indented JSON array, for a terminal or a download."""
    rows = (df.orderBy(order_by) if order_by and order_by in df.columns else df).select(column).toLocalIterator()
    return json.dumps([json.loads(r[0]) for r in rows], indent=2, ensure_ascii=ascii_only)
