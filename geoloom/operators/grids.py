"""Regular grids: cells, stacked points, heat maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as g


def cell_of(axis: str, size: float) -> Column:
    return F.floor(F.col(axis) / size).cast("bigint")


def grid_cells(boxes: DataFrame, size: float) -> DataFrame:
    """Cells of `size` that cover each box, as polygons, with column and row numbers from 0."""
    across = F.ceil((F.col("maxx") - F.col("minx")) / size).cast("int")
    up = F.ceil((F.col("maxy") - F.col("miny")) / size).cast("int")
    cells = (boxes.select("id", "minx", "miny", F.greatest(across, F.lit(1)).alias("_w"), F.greatest(up, F.lit(1)).alias("_h"))
             .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)))
             .withColumn("row", F.explode(F.sequence(F.lit(0), F.col("_h") - 1))))
    x, y = F.col("minx") + F.col("col") * size, F.col("miny") + F.col("row") * size
    return cells.select("id", "col", "row", g.box(x, y, x + size, y + size).alias("geom"))


def point_stacker(points: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    """Per grid cell: points, distinct positions, mean position."""
    keys = keys or []
    spots = points.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("_n"))
    return spots.groupBy(*keys, cell_of("x", size).alias("cx"), cell_of("y", size).alias("cy")).agg(
        F.sum("_n").alias("count"), F.count(F.lit(1)).alias("unique_count"),
        (F.sum(F.col("x") * F.col("_n")) / F.sum("_n")).alias("x"),
        (F.sum(F.col("y") * F.col("_n")) / F.sum("_n")).alias("y"))


def heatmap(points: DataFrame, size: float, radius: int, weight: str | None = None) -> DataFrame:
    """Smoothed weight per cell, and its share of the largest.

    Points are first summed per cell; each cell then gives to the cells within `radius`, less with
    distance (quartic kernel).
    """
    w = F.col(weight) if weight else F.lit(1.0)
    cells = points.groupBy(cell_of("x", size).alias("cx"), cell_of("y", size).alias("cy")).agg(F.sum(w).alias("w"))
    reach = [(dx, dy, (1 - (dx * dx + dy * dy) / (radius + 1) ** 2) ** 2)
             for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)
             if dx * dx + dy * dy < (radius + 1) ** 2]
    kernel = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(k).alias("k"))
                                 for dx, dy, k in reach]))
    spread = cells.select("cx", "cy", "w", kernel.alias("k")).groupBy(
        (F.col("cx") + F.col("k.dx")).alias("cx"), (F.col("cy") + F.col("k.dy")).alias("cy")).agg(
            F.sum(F.col("w") * F.col("k.k")).alias("density"))
    top = spread.agg(F.max("density")).scalar()
    return spread.withColumn("intensity", F.col("density") / top)
