"""Indicators of a stream of texts.

The scan is an expression over one row, so a stream takes the same plan as a table and
keeps no state.  Counts by time need a watermark, which bounds their state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.indicators import static_entities


def indicators(stream: DataFrame, key: str = "artifact_id", text: str = "text") -> DataFrame:
    """One row for each static entity; other columns pass through."""
    rows = stream.withColumn("e", F.explode(static_entities(F.col(text), F.col(key))))
    return rows.select(*(c for c in stream.columns if c != text), "e.type", "e.value", "e.trust", "e.id")


def counts(found: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Entities by window, type and trust; rows more than ``late`` behind are dropped by the watermark."""
    out = found.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "type", "trust").agg(F.count("*").alias("n"))
    return out.select("w.start", "w.end", "type", "trust", "n")
