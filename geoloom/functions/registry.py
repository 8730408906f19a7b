"""Published function names, and what builds each of them here."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.functions import scalar as s
from geoloom.operators import classes, collections, grids, linear, nearest, simplify
from geoloom.operators import relate as r

FUNCTIONS = {
    # math
    "abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "atan2": F.atan2, "cos": F.cos,
    "sin": F.sin, "tan": F.tan, "ceil": F.ceil, "floor": F.floor, "exp": F.exp, "sqrt": F.sqrt,
    "pi": s.pi, "log": F.ln, "pow": F.pow, "rint": F.rint, "round": s.round_half_up,
    "roundDouble": s.round_half_up, "IEEEremainder": s.ieee_remainder, "modulo": s.modulo,
    "max": s.maximum, "min": s.minimum, "random": s.random, "toDegrees": F.degrees, "toRadians": F.radians,
    # comparison
    "equalTo": operator.eq, "notEqualTo": operator.ne, "greaterThan": operator.gt,
    "greaterEqualThan": operator.ge, "lessThan": operator.lt, "lessEqualThan": operator.le,
    "between": s.between, "in": s.member_of, "isLike": s.is_like, "isNull": F.isnull, "not": operator.inv,
    "if_then_else": s.if_then_else, "PropertyExists": s.property_exists, "isInstanceOf": s.is_instance_of,
    # conversion
    "convert": s.convert, "parseBoolean": s.parse_boolean, "parseDouble": s.parse_double,
    "parseInt": s.parse_int, "parseLong": s.parse_long, "double2bool": s.number_to_bool,
    "int2bbool": s.number_to_bool, "int2ddouble": lambda x: x.cast("double"),
    "numberFormat": s.number_format, "numberFormat2": s.number_format2,
    "dateFormat": s.date_format, "dateParse": s.date_parse,
    # strings
    "Concatenate": s.concatenate, "strConcat": s.concatenate, "length": F.length, "strLength": F.length,
    "strCapitalize": F.initcap, "strEndsWith": F.endswith, "strStartsWith": F.startswith,
    "strEqualsIgnoreCase": s.equals_ignore_case, "strIndexOf": s.index_of, "strLastIndexOf": s.last_index_of,
    "strMatches": s.is_like, "strPosition": s.position, "strReplace": s.replace, "strSubstring": s.substring,
    "strSubstringStart": s.substring_start, "strToLowerCase": F.lower, "strToUpperCase": F.upper,
    "strTrim": F.trim, "strTrim2": s.trim2, "stringTemplate": s.string_template,
    # properties and value tables
    "property": F.col, "id": lambda: F.col("id"), "list": F.array, "Categorize": s.categorize,
    "Recode": s.recode, "Interpolate": s.interpolate, "Feature": F.struct,
    # geometry
    "geometry": lambda: F.col("geom"), "geometryType": lambda c: c["kind"], "dimension": g.dimension,
    "geomFromWKT": g.from_wkt, "toWKT": g.to_wkt, "getX": g.get_x, "getY": g.get_y,
    "getGeometryN": g.geometry_n, "numGeometries": g.num_geometries, "pointN": g.point_n,
    "numPoints": g.num_points, "startPoint": g.start_point, "endPoint": g.end_point,
    "exteriorRing": g.exterior_ring, "interiorRingN": g.interior_ring_n,
    "numInteriorRing": g.num_interior_rings, "vertices": g.vertices, "isClosed": g.is_closed,
    "isEmpty": g.is_empty, "isRing": g.is_ring, "envelope": g.envelope, "centroid": g.centroid,
    "Area": g.area, "area2": g.area, "geomLength": g.geom_length, "distance": r.distance,
    "isWithinDistance": r.is_within_distance, "startAngle": g.start_angle, "endAngle": g.end_angle,
    "setCRS": g.set_crs, "equalsExact": g.equals_exact, "equalsExactTolerance": g.equals_exact_tolerance,
    "offset": g.offset,
    # predicates between two geometries
    **{name: (lambda a, b, name=name: r.holds(name, a, b)) for name in (
        "contains", "crosses", "disjoint", "intersects", "overlaps", "touches", "within")},
}

# Typed and numbered variants of one function (fixed values).
_VARIANTS = {
    "abs": ["abs_2", "abs_3", "abs_4"], "max": ["max_2", "max_3", "max_4"],
    "min": ["min_2", "min_3", "min_4"], "round": ["round_2"],
    "in": [f"in{n}" for n in range(2, 11)],
}
for _name, _others in _VARIANTS.items():
    for _other in _others:
        FUNCTIONS[_other] = FUNCTIONS[_name]


def _one(function: str):
    return lambda df, value: collections.aggregate(df, value, [function])


# Functions of whole tables: they take and give DataFrames.
TABLE_FUNCTIONS = {
    "Aggregate": collections.aggregate, "Collection_Average": _one("average"), "Collection_Max": _one("max"),
    "Collection_Min": _one("min"), "Collection_Sum": _one("sum"), "Collection_Count": _one("count"),
    "Collection_Median": _one("median"), "Collection_Unique": collections.unique, "Unique": collections.unique,
    "Collection_Bounds": collections.collection_bounds, "Bounds": collections.collection_bounds,
    "Collection_Nearest": nearest.nearest, "Nearest": nearest.nearest_join,
    "Count": lambda df: df.agg(F.count(F.lit(1)).alias("count")), "Query": collections.query_features,
    "Transform": collections.transform_features, "EqualInterval": classes.equal_interval, "Quantile": classes.quantile,
    "StandardDeviation": classes.standard_deviation, "UniqueInterval": classes.unique_interval, "Jenks": classes.jenks,
    "classify": classes.classify, "UnionFeatureCollection": collections.union_collections,
    "InclusionFeatureCollection": collections.inclusion_collection,
    "IntersectionFeatureCollection": collections.intersection_collection,
    "VectorZonalStatistics": collections.zonal_statistics, "PointStacker": grids.point_stacker,
    "Heatmap": grids.heatmap, "Grid": grids.grid_cells, "Snap": nearest.snap, "Clip": collections.clip,
    "RectangularClip": collections.clip, "Reproject": collections.reproject_features,
    "PointBuffers": collections.point_buffers, "BufferFeatureCollection": collections.point_buffers,
    "CollectGeometries": collections.collect_geometries, "convexHull": collections.convex_hull,
    "LRSGeocode": linear.geocode, "LRSMeasure": linear.measure_at, "LRSSegment": linear.segment_between,
    "Simplify": simplify.simplify_features,
}


def call(name: str, *args, **options) -> Column:
    """Build a function by its published name."""
    return FUNCTIONS[name](*args, **options)


def table_call(name: str, *args, **options) -> DataFrame:
    """Run a table-level function by its published name."""
    return TABLE_FUNCTIONS[name](*args, **options)
