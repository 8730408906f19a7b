"""Feature queries, edits and whole-collection results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from geoloom.functions import geometry as g
from geoloom.operators.blocks import sums_in_blocks
from geoloom.operators.ordering import median
from geoloom.operators.skew import computed_once, null_safe_join
from geoloom.operators.spatial import bbox_filter, kind_of, related, spatial_join, spatial_semi, with_box


def query_features(df: DataFrame, where: Column | None = None, properties: list[str] | None = None,
                   order: list[Column] | None = None, max_features: int | None = None) -> DataFrame:
    """Filter, sort, limit and project, in that order. Without `max_features` every row is returned."""
    if where is not None:
        df = df.filter(where)
    if order:
        df = df.orderBy(*order)
    if max_features is not None:
        df = df.limit(max_features)
    return df.select(*properties) if properties else df


def apply_changes(df: DataFrame, inserts: DataFrame | None = None, updates: DataFrame | None = None,
                  deletes: DataFrame | None = None, key: str = "id") -> DataFrame:
    """New snapshot: deleted and updated rows leave, updated and inserted ones join.

    An update of an unknown key is ignored.
    """
    out = df
    if deletes is not None:
        out = out.join(deletes.select(key), key, "left_anti")
    if updates is not None:
        fresh = updates.select(*df.columns).join(out.select(key), key, "left_semi")
        out = out.join(updates.select(key), key, "left_anti").unionByName(fresh)
    if inserts is not None:
        out = out.unionByName(inserts.select(*df.columns))
    return out


def transform_features(df: DataFrame, **definitions: str) -> DataFrame:
    """New attributes from SQL expressions over the old ones."""
    return df.selectExpr(*[f"{text} as `{name}`" for name, text in definitions.items()])


def reproject_features(df: DataFrame, target: int) -> DataFrame:
    """Geometries moved to another reference system, vertex by vertex."""
    return df.withColumn("geom", g.reproject(F.col("geom"), target))


AGGREGATES = {
    "count": lambda v: F.count(v), "sum": lambda v: F.sum(v), "average": lambda v: F.avg(v),
    "min": lambda v: F.min(v), "max": lambda v: F.max(v), "std_dev": lambda v: F.stddev_samp(v),
    "distinct": lambda v: F.count_distinct(v),
}


def aggregate(df: DataFrame, value: str, functions: list[str], keys: list[str] | None = None) -> DataFrame:
    """Named aggregates of a column, per key or over everything; `median` is exact."""
    keys = keys or []
    plain = [AGGREGATES[f](F.col(value)).alias(f) for f in functions if f != "median"]
    out = df.groupBy(*keys).agg(*plain) if plain else None
    if "median" in functions:
        middle = median(df, value, keys)
        if out is None:
            out = middle
        elif keys:
            out = null_safe_join(out, middle, keys, "left")
        else:
            out = out.withColumn("median", middle.select("median").scalar())
    return out.select(*keys, *functions)


def collection_bounds(df: DataFrame) -> DataFrame:
    return with_box(df).agg(F.min("minx").alias("minX"), F.max("maxx").alias("maxX"),
                            F.min("miny").alias("minY"), F.max("maxy").alias("maxY"))


def unique(df: DataFrame, value: str) -> DataFrame:
    return df.select(value).distinct()


def union_collections(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def inclusion_collection(a: DataFrame, b: DataFrame, **grid) -> DataFrame:
    """Features of `a` that lie within some feature of `b`."""
    return spatial_semi(a, b, "within", **grid)


def intersection_collection(a: DataFrame, b: DataFrame, **grid) -> DataFrame:
    """Pairs that intersect, with the attributes of both and the geometry of `a`."""
    box = {"minx", "maxx", "miny", "maxy"}
    keep = [*["l_" + c for c in a.columns if c not in box], *["r_" + c for c in b.columns if c not in {"geom", *box}]]
    return spatial_join(a, b, "intersects", keep, **grid)


def zonal_statistics(features: DataFrame, zones: DataFrame, value: str, predicate: str = "intersects",
                     **grid) -> DataFrame:
    """Statistics of the features in each zone; empty zones count 0.

    With geometries and values that are doubles the pairs are summed up where they are found.
    """
    v = F.col("l_" + value)
    kinds = kind_of(features), kind_of(zones)
    if "geometry" in kinds and dict(features.dtypes)[value] == "double":
        parts = sums_in_blocks(features, zones, value, *related(predicate, kinds), **grid)
        of_zone = Window.partitionBy("r_id")
        mean = F.sum("total").over(of_zone) / F.sum("n").over(of_zone)
        away = parts.withColumn("_away", F.col("m2") + F.col("n") * F.pow(F.col("mean") - mean, F.lit(2.0)))
        n = F.sum("n")
        stats = away.groupBy(F.col("r_id").alias("id")).agg(
            n.alias("count"), F.min("low").alias("min"), F.max("high").alias("max"), F.sum("total").alias("sum"),
            (F.sum("total") / n).alias("avg"), F.sqrt(F.sum("_away") / n).alias("stddev"))
    else:
        stats = spatial_join(features, zones, predicate, **grid).groupBy(F.col("r_id").alias("id")).agg(
            F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"),
            F.avg(v).alias("avg"), F.stddev_pop(v).alias("stddev"))
    return zones.select("id").join(stats, "id", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def clip(df: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Features that meet a rectangle. Points are cut exactly; others are kept whole."""
    return bbox_filter(df, minx, miny, maxx, maxy)


def collect_geometries(df: DataFrame, keys: list[str], members: int = 10_000) -> DataFrame:
    """Multi geometries per key, from rows of one kind.

    A key with more rows than `members` gives several geometries (`part` of `parts`), so that no
    group has to fit in one row. Everything is kept.
    """
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / members).alias("parts"))
    multi = g.promote(F.col("geom"))
    cut = null_safe_join(df, sizes, keys).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("bigint"))
    out = cut.groupBy(*keys, "part", "parts").agg(
        F.min(multi["kind"]).alias("_kind"), F.min(multi["srid"]).alias("_srid"),
        F.sort_array(F.collect_list(F.struct("id", multi["parts"].alias("p")))).alias("_all"))
    parts = F.flatten(F.transform("_all", lambda r: r["p"]))
    return out.select(*keys, "part", "parts", g.make(F.col("_kind"), parts, F.col("_srid")).alias("geom"))


def point_buffers(df: DataFrame, radius, corners: int = 32) -> DataFrame:
    """Circles around points, as polygons."""
    turn = F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda i: g.vertex(
        F.col("x") + F.cos(F.pmod(i, F.lit(corners)) * (2 * math.pi / corners)) * radius,
        F.col("y") + F.sin(F.pmod(i, F.lit(corners)) * (2 * math.pi / corners)) * radius))
    return df.withColumn("geom", g.polygon(turn))


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corner positions, counter-clockwise from the lowest (x, y)."""
    pts = np.unique(np.column_stack([x, y]), axis=0)
    if len(pts) < 3:
        return pts

    def chain(seq):
        out = []
        for p in seq:
            while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                    - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(chain(pts)[:-1] + chain(pts[::-1])[:-1])


@F.pandas_udf(ArrayType(DoubleType()))
def _corners(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Hulls of bounded lists of points: all x, then all y."""
    return pd.Series([_hull(np.asarray(x), np.asarray(y)).T.ravel() for x, y in zip(xs, ys)])


DIRECTIONS = 16  # extreme points taken of each key
HULL_SHARE = 4096  # points of a key that are put in one list
HULL_MERGED = 64  # lists of corners that are merged at once


def _strictly_inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is left of every side of a ring given as a list of (x, y), by more than rounding."""
    sides = F.filter(F.zip_with(ring, F.concat(F.slice(ring, 2, DIRECTIONS - 1), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                     lambda s: s["a"] != s["b"])

    def left(s):
        down, across = (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]), (s["b"]["y"] - s["a"]["y"]) * (x - s["a"]["x"])
        return down - across > 1e-12 * (F.abs(down) + F.abs(across))

    return (F.size(sides) > 0) & F.forall(sides, left)


def convex_hull(points: DataFrame, key: str = "locator") -> DataFrame:
    """Hull per key from (key, x, y) rows, as a point, line or polygon; a null key is one like any other.

    The extreme points of a key in fixed directions come from one aggregate. What lies inside their polygon is dropped; of the rest
    shares of a bounded size are reduced to their corners, then lists of corners are merged up a tree.
    Rows without both coordinates are left out, and so is a key that has no others.
    """
    flat = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).na.drop(subset=["x", "y"])
    turns = [2 * math.pi * k / DIRECTIONS for k in range(DIRECTIONS)]
    far = [F.max(F.struct((F.col("x") * math.cos(t) + F.col("y") * math.sin(t)).alias("d"), "x", "y")) for t in turns]
    rings = flat.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(f"_{k}") for k, c in enumerate(far)])
    rings = rings.select(key, F.ceil(F.col("_n") / HULL_SHARE).alias("_shares"),
                         F.array(*[F.struct(F.col(f"_{k}.x").alias("x"), F.col(f"_{k}.y").alias("y")) for k in range(DIRECTIONS)]).alias("_ring"))
    outer = null_safe_join(flat, rings, [key]).filter(~_strictly_inside(F.col("x"), F.col("y"), F.col("_ring")))
    lists = outer.groupBy(key, F.pmod(F.xxhash64("x", "y"), "_shares").alias("_part")).agg(
        F.collect_list(F.struct("x", "y")).alias("_p")).select(key, "_part", F.col("_p.x").alias("xs"), F.col("_p.y").alias("ys"))

    def reduced(df: DataFrame) -> DataFrame:
        found = computed_once(df, _c=_corners("xs", "ys"))
        n = (F.size("_c") / 2).cast("int")
        return found.select(key, "_part", F.slice("_c", 1, n).alias("xs"), F.slice("_c", n + 1, n).alias("ys"))

    def merged(df: DataFrame, part: Column) -> DataFrame:
        return df.groupBy(key, part.alias("_part")).agg(F.flatten(F.collect_list("xs")).alias("xs"), F.flatten(F.collect_list("ys")).alias("ys"))

    by_share = reduced(lists)
    whole = reduced(merged(reduced(merged(by_share, F.floor(F.col("_part") / HULL_MERGED))), F.lit(0)))
    v = F.zip_with("xs", "ys", g.vertex)
    n = F.size("xs")
    closed = F.when(n > 2, F.concat(v, F.slice(v, 1, 1))).otherwise(v)
    name = F.when(n > 2, "POLYGON").when(n == 2, "LINESTRING").otherwise("POINT")
    return whole.select(key, g.make(name, F.array(F.array(closed))).alias("geom"))

