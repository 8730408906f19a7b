"""Lengths of tracks whose vertices are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.ordering import binned


def track_lengths(points: DataFrame, keys: list[str], order: list[str], bins: int = 64) -> DataFrame:
    """(keys, vertices, length) of each key's points in order; the first order column is a time.

    A track is cut at times that split all rows evenly. Pieces are measured on their own, then
    the gaps between their ends are added, so a very long track is no single task's work.
    """
    rows = points.select(*keys, *order, "x", "y", F.unix_micros(F.col(order[0])).cast("double").alias("_at"))
    rows = binned(rows, "_at", bins)
    rank = F.struct(*order)
    step = Window.partitionBy(*keys, "_bin").orderBy(*order)
    dx, dy = (F.col(a) - F.lag(a).over(step) for a in "xy")
    pieces = rows.withColumn("_step", F.hypot(dx, dy)).groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("_inner"),
        F.min_by(F.struct("x", "y"), rank).alias("_first"), F.max_by(F.struct("x", "y"), rank).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bin"))  # at most `bins` rows a key
    gap = F.hypot(F.col("_first.x") - F.col("_before.x"), F.col("_first.y") - F.col("_before.y"))
    return pieces.withColumn("_before", before).groupBy(*keys).agg(
        F.sum("_n").alias("vertices"), (F.sum("_inner") + F.coalesce(F.sum(gap), F.lit(0.0))).alias("length"))
