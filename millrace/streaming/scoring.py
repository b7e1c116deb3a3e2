"""The library's signals over streams: they are column expressions, so they run on what arrives as on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T


def score_stream(records: DataFrame, least: float = 0.0) -> DataFrame:
    """Records of a stream with authenticity and richness, and only those of at least some authenticity: without state, so without a watermark."""
    t = F.col("text")
    return records.withColumn("authenticity", T.authenticity(t)).withColumn("richness", T.lexical_richness(t)).where(F.col("authenticity") >= least)


def composition_stream(records: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of records per window and group, for a composition report of a stream; state goes when a window is later than the watermark."""
    return records.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), by).count()
