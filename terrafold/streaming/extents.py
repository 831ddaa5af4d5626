"""Spatial aggregates on streams: all scalar functions work on streaming DataFrames; extents over time windows are here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import columns as C


def windowed_extent(df: DataFrame, time: str, box: Column, width: str, late: str, *keys: str) -> DataFrame:
    """The extent of the boxes in each time window (and key); rows later than the watermark are dropped."""
    marked = df.withColumn("__box", box).withWatermark(time, late)
    out = marked.groupBy(F.window(time, width), *keys).agg(C.st_extent("__box").alias("extent"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "extent")
