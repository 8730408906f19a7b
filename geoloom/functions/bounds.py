"""Bounding boxes as `struct<minX,maxX,minY,maxY>` columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
MERCATOR_LAT = 85.05112877980659


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def make_bounds(x1, y1, x2, y2) -> Column:
    """Box from two corner points, whichever way round they are given."""
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    return F.struct(F.least(x1, x2).alias("minX"), F.greatest(x1, x2).alias("maxX"),
                    F.least(y1, y2).alias("minY"), F.greatest(y1, y2).alias("maxY"))


def bounds_geojson(bounds: Column | str) -> Column:
    """GeoJSON of a box. A flat box is a LineString, a single position a Point; null stays null."""
    b = _c(bounds)
    minx, maxx, miny, maxy = (b[n] for n in ("minX", "maxX", "minY", "maxY"))

    def doc(kind: str, coordinates: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))

    ring = F.array(F.array(minx, miny), F.array(minx, maxy), F.array(maxx, maxy),
                   F.array(maxx, miny), F.array(minx, miny))
    flat_x, flat_y = minx == maxx, miny == maxy
    return (F.when(b.isNull(), F.lit(None).cast("string"))
            .when(flat_x & flat_y, doc("Point", F.array(minx, miny)))
            .when(flat_x | flat_y, doc("LineString", F.array(F.array(minx, miny), F.array(maxx, maxy))))
            .otherwise(doc("Polygon", F.array(ring))))


def overlaps_box(bounds: Column | str, minx, miny, maxx, maxy) -> Column:
    """Boxes share at least one position."""
    b = _c(bounds)
    return ((b["minX"] <= _c(maxx)) & (b["maxX"] >= _c(minx))
            & (b["minY"] <= _c(maxy)) & (b["maxY"] >= _c(miny)))


def to_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    lat = F.least(F.greatest(y, F.lit(-MERCATOR_LAT)), F.lit(MERCATOR_LAT))
    return (x * F.lit(math.pi / 180 * EARTH_RADIUS),
            F.log(F.tan(F.lit(math.pi / 4) + lat * F.lit(math.pi / 360))) * F.lit(EARTH_RADIUS))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return (x * F.lit(180 / math.pi / EARTH_RADIUS),
            F.atan(F.exp(y / F.lit(EARTH_RADIUS))) * F.lit(360 / math.pi) - F.lit(90.0))


def reproject_bounds(bounds: Column | str, source: Column | str, target: str = "EPSG:4326") -> Column:
    """Move a box between EPSG:4326 and EPSG:3857. Any other source code gives null."""
    b, src = _c(bounds), _c(source)
    moved = to_mercator if target == "EPSG:3857" else from_mercator
    other = "EPSG:4326" if target == "EPSG:3857" else "EPSG:3857"
    lo, hi = moved(b["minX"], b["minY"]), moved(b["maxX"], b["maxY"])
    return F.when(src == target, b).when(src == other, F.struct(
        lo[0].alias("minX"), hi[0].alias("maxX"), lo[1].alias("minY"), hi[1].alias("maxY")))


def overall_extent(df, bounds: str = "latlon_bounds"):
    """Union of all boxes of a table, one row; rows without a box are left out."""
    b = F.col(bounds)
    return df.filter(b.isNotNull()).agg(
        F.min(b["minX"]).alias("minX"), F.max(b["maxX"]).alias("maxX"),
        F.min(b["minY"]).alias("minY"), F.max(b["maxY"]).alias("maxY"))
