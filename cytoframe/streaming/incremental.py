"""Counts and levels kept up to date as files of sites arrive.

The state of either is a plain aggregation by key, so Structured Streaming holds it: sums for merged counts, counters for levels. Run in update or complete
mode. Without a watermark the state of merged counts grows with the genome's positions, which are bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.operators import levels as L
from cytoframe.sources import text as T


def site_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Sites of counts files as they appear in a folder."""
    return T.parse_counts(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def merged_counts(sites: DataFrame) -> DataFrame:
    """Running sums by position."""
    return sites.groupBy("chrom", "pos").agg(F.sum("n_meth").alias("n_meth"), F.sum("n_reads").alias("n_reads"))


def running_levels(sites: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Running counters by key."""
    return sites.groupBy(*keys).agg(*L.counters())
