"""Edges that arrive as a stream, kept as degree counts; optional, as the batch operators need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fan_out_counts(edges: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """edges (src, dst, ts), streaming: new edges of each source by window; late ones are dropped after the watermark."""
    return edges.withWatermark("ts", late).groupBy(F.window("ts", window), "src").agg(F.count("*").alias("n"), F.approx_count_distinct("dst").alias("targets"))


def distinct_edges(edges: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (src, dst) once within the watermark."""
    return edges.withWatermark("ts", late).dropDuplicatesWithinWatermark(["src", "dst"])
