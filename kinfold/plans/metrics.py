"""Counts about a run: sizes, reduction, coverage by source, confidence bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reduction(fragments: DataFrame, clusters: DataFrame) -> DataFrame:
    """n_sources, n_fragments, n_records, reduction_pct; clusters has (fid, cluster)."""
    both = fragments.select("fid", "source").join(clusters, "fid", "left")
    found = both.agg(F.countDistinct("source").alias("n_sources"), F.count("*").alias("n_fragments"), F.countDistinct("cluster").alias("n_records"))
    pct = F.when(F.col("n_fragments") > 0, F.round((1 - F.col("n_records") / F.col("n_fragments")) * 100, 4)).otherwise(0.0)
    return found.withColumn("reduction_pct", pct)


def source_coverage(fragments: DataFrame, clusters: DataFrame) -> DataFrame:
    """(source, n_records): records that a source speaks for."""
    return fragments.select("fid", "source").join(clusters, "fid").groupBy("source").agg(F.countDistinct("cluster").alias("n_records"))


def multi_source(fragments: DataFrame, clusters: DataFrame) -> DataFrame:
    """n_multi: records that more than one source speaks for."""
    per = fragments.select("fid", "source").join(clusters, "fid").groupBy("cluster").agg(F.countDistinct("source").alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("n_multi"))


def confidence_bands(records: DataFrame) -> DataFrame:
    """high (.85 or more), medium (.60 or more) and low counts of overall_confidence."""
    c = F.col("overall_confidence")
    return records.agg(F.count_if(c >= 0.85).alias("high"), F.count_if((c >= 0.60) & (c < 0.85)).alias("medium"), F.count_if(c < 0.60).alias("low"))
