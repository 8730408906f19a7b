"""Geometry columns: `struct<kind, parts, srid>`, parts being members of rings of vertices.

A point is one member with one ring of one vertex, a line one member with one ring, a polygon
one member with its outer ring first. Plain nested data: Catalyst prunes and pushes into it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.bounds import from_mercator, to_mercator

DIMENSION = {"POINT": 0, "MULTIPOINT": 0, "LINESTRING": 1, "MULTILINESTRING": 1,
             "POLYGON": 2, "MULTIPOLYGON": 2}
_PARTS = "array<array<array<struct<x:double,y:double>>>>"
_VERTS = "array<struct<x:double,y:double>>"


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def _let(value: Column, build) -> Column:
    """`build(value)` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), build)[0]


# --- construction ---

def make(kind, parts: Column, srid=4326) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), parts.cast(_PARTS).alias("parts"),
                    _c(srid).cast("bigint").alias("srid"))


def vertex(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def point(x, y, srid=4326) -> Column:
    return make("POINT", F.array(F.array(F.array(vertex(x, y)))), srid)


def line(vertices: Column, srid=4326) -> Column:
    return make("LINESTRING", F.array(F.array(vertices)), srid)


def polygon(*rings: Column, srid=4326) -> Column:
    return make("POLYGON", F.array(F.array(*rings)), srid)


def box(minx, miny, maxx, maxy, srid=4326) -> Column:
    ring = F.array(vertex(minx, miny), vertex(maxx, miny), vertex(maxx, maxy), vertex(minx, maxy), vertex(minx, miny))
    return polygon(ring, srid=srid)


def promote(g: Column) -> Column:
    """The multi kind of a geometry."""
    kind = F.when(g["kind"].startswith("MULTI"), g["kind"]).otherwise(F.concat(F.lit("MULTI"), g["kind"]))
    return make(kind, g["parts"], g["srid"])


# --- text ---

def from_wkt(text, srid=4326) -> Column:
    return _let(_c(text), lambda t: _read_wkt(t, srid))


def _read_wkt(text: Column, srid) -> Column:
    kind = F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    empty = text.rlike(r"(?i)\bEMPTY\s*$")
    body = F.regexp_replace(text, r"^\s*[A-Za-z]+\s*", "")
    # One separator per level: ';' between members, '|' between rings, ',' between vertices.
    rings = r"\)\s*,\s*\("
    marked = (F.when(kind == "MULTIPOLYGON", F.regexp_replace(
                  F.regexp_replace(body, r"\)\s*\)\s*,\s*\(\s*\(", ";"), rings, "|"))
              .when(kind == "POLYGON", F.regexp_replace(body, rings, "|"))
              .when(kind == "MULTILINESTRING", F.regexp_replace(body, rings, ";"))
              .when(kind == "MULTIPOINT", F.regexp_replace(body, ",", ";")).otherwise(body))
    plain = F.regexp_replace(marked, r"[()]", "")

    def read_vertex(v: Column) -> Column:
        xy = F.split(F.trim(v), r"\s+")
        return F.struct(xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))

    parts = F.transform(F.split(plain, ";"), lambda m: F.transform(
        F.split(m, r"\|"), lambda r: F.transform(F.split(r, ","), read_vertex)))
    parts = F.when(empty, F.array().cast(_PARTS)).otherwise(parts)
    return F.when(kind.isin(*DIMENSION), make(kind, parts, srid))


def _number(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def to_wkt(g: Column) -> Column:
    return _let(g, _write_wkt)


def _write_wkt(g: Column) -> Column:
    def put_ring(r: Column) -> Column:
        return F.array_join(F.transform(r, lambda v: F.concat(_number(v["x"]), F.lit(" "), _number(v["y"]))), ", ")

    def wrapped(c: Column) -> Column:
        return F.concat(F.lit("("), c, F.lit(")"))

    def joined(members: Column) -> Column:
        return F.array_join(members, ", ")

    areas = F.transform(g["parts"], lambda m: wrapped(joined(F.transform(m, lambda r: wrapped(put_ring(r))))))
    lines = F.transform(g["parts"], lambda m: wrapped(put_ring(m[0])))
    body = (F.when(g["kind"] == "MULTIPOLYGON", wrapped(joined(areas))).when(g["kind"] == "POLYGON", areas[0])
            .when(g["kind"].isin("MULTILINESTRING", "MULTIPOINT"), wrapped(joined(lines))).otherwise(lines[0]))
    return F.concat(g["kind"], F.lit(" "), F.when(F.size(g["parts"]) == 0, F.lit("EMPTY")).otherwise(body))


# --- accessors ---

def vertices(g: Column) -> Column:
    return F.flatten(F.flatten(g["parts"]))


def dimension(g: Column) -> Column:
    return F.when(g["kind"].endswith("POLYGON"), 2).when(g["kind"].endswith("LINESTRING"), 1).otherwise(0)


def get_x(g: Column) -> Column:
    return F.get(vertices(g), F.lit(0))["x"]


def get_y(g: Column) -> Column:
    return F.get(vertices(g), F.lit(0))["y"]


def num_geometries(g: Column) -> Column:
    return F.size(g["parts"])


def num_points(g: Column) -> Column:
    return F.size(vertices(g))


def _part(g: Column, kind, parts: Column) -> Column:
    """A geometry, or null where its parts are null."""
    return F.when(parts.isNotNull(), make(kind, parts, g["srid"]))


def _nth(values: Column, n) -> Column:
    return F.get(values, _c(n).cast("int"))


def geometry_n(g: Column, n) -> Column:
    """Member n, from 0; null past the end."""
    member = _nth(g["parts"], n)
    return _part(g, F.regexp_replace(g["kind"], "^MULTI", ""), F.when(member.isNotNull(), F.array(member)))


def _vertex_point(g: Column, v: Column) -> Column:
    return _part(g, "POINT", F.when(v.isNotNull(), F.array(F.array(F.array(v)))))


def point_n(g: Column, n) -> Column:
    return _vertex_point(g, _nth(vertices(g), n))


def start_point(g: Column) -> Column:
    return point_n(g, 0)


def end_point(g: Column) -> Column:
    return _vertex_point(g, F.try_element_at(vertices(g), F.lit(-1)))


def _ring(g: Column, n) -> Column:
    return _nth(F.get(g["parts"], F.lit(0)), n)


def _ring_line(g: Column, ring: Column) -> Column:
    return _part(g, "LINESTRING", F.when(ring.isNotNull() & (dimension(g) == 2), F.array(F.array(ring))))


def exterior_ring(g: Column) -> Column:
    return _ring_line(g, _ring(g, 0))


def interior_ring_n(g: Column, n) -> Column:
    return _ring_line(g, _ring(g, _c(n) + 1))


def num_interior_rings(g: Column) -> Column:
    return F.when(dimension(g) == 2, F.size(F.get(g["parts"], F.lit(0))) - 1)


def is_empty(g: Column) -> Column:
    return F.size(vertices(g)) == 0


def is_closed(g: Column) -> Column:
    """Every line of the geometry ends where it starts."""
    return F.forall(F.flatten(g["parts"]), lambda r: r[0] == F.element_at(r, -1))


def is_ring(g: Column) -> Column:
    return (g["kind"] == "LINESTRING") & is_closed(g) & (num_points(g) > 3)


def envelope(g: Column) -> Column:
    """Box struct of all vertices; null when there are none."""
    def of(v: Column) -> Column:
        xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
        return F.when(F.size(v) > 0, F.struct(F.array_min(xs).alias("minX"), F.array_max(xs).alias("maxX"),
                                              F.array_min(ys).alias("minY"), F.array_max(ys).alias("maxY")))
    return _let(vertices(g), of)


def envelope_geometry(g: Column) -> Column:
    return _let(envelope(g), lambda e: box(e["minX"], e["minY"], e["maxX"], e["maxY"], g["srid"]))


def set_crs(g: Column, srid) -> Column:
    return make(g["kind"], g["parts"], srid)


# --- measures ---

def segments(ring: Column) -> Column:
    """Consecutive vertex pairs (a, b) of a ring or line."""
    def pairs(r: Column) -> Column:
        n = F.greatest(F.size(r) - 1, F.lit(0))
        return F.zip_with(F.slice(r, 1, n), F.slice(r, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return _let(ring, pairs)


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + of(v))


def _segment_length(s: Column) -> Column:
    return F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])


def _cross(s: Column) -> Column:
    return s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]


def ring_area(ring: Column) -> Column:
    """Positive when the ring runs counter-clockwise."""
    return _sum(segments(ring), _cross) / 2


def geom_length(g: Column) -> Column:
    """Length of lines, perimeter of polygons."""
    return F.when(dimension(g) == 0, 0.0).otherwise(
        _sum(F.flatten(g["parts"]), lambda r: _sum(segments(r), _segment_length)))


def area(g: Column) -> Column:
    """Outer rings less holes; zero for points and lines."""
    def member(m: Column) -> Column:
        return F.abs(ring_area(m[0])) - _sum(F.slice(m, 2, F.size(m)), lambda r: F.abs(ring_area(r)))
    return F.when(dimension(g) == 2, _sum(g["parts"], member)).otherwise(0.0)


def centroid(g: Column) -> Column:
    """Area-weighted for polygons, length-weighted for lines, else the mean position."""
    return _let(g, _centroid)


def _centroid(g: Column) -> Column:
    empty = F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")
    lines = F.aggregate(F.flatten(g["parts"]), empty, lambda acc, r: F.concat(acc, segments(r)))

    def moment(axis: str) -> tuple[Column, Column]:
        long = _sum(lines, lambda s: _segment_length(s) * (s["a"][axis] + s["b"][axis]) / 2)
        mean = _sum(vertices(g), lambda v: v[axis]) / F.nullif(num_points(g), F.lit(0))

        def ring_moment(ring: Column) -> Column:
            return _sum(segments(ring), lambda s: _cross(s) * (s["a"][axis] + s["b"][axis])) / 6

        def member(m: Column) -> Column:
            # A ring's direction decides the sign of its moment; holes count against the outside.
            outer = ring_moment(m[0]) * F.signum(ring_area(m[0]))
            return outer - _sum(F.slice(m, 2, F.size(m)), lambda r: ring_moment(r) * F.signum(ring_area(r)))

        flat = long / F.nullif(geom_length(g), F.lit(0.0))
        full = _sum(g["parts"], member) / F.nullif(area(g), F.lit(0.0))
        return F.when(dimension(g) == 2, F.coalesce(full, flat, mean)).when(
            dimension(g) == 1, F.coalesce(flat, mean)).otherwise(mean)

    return F.when(~is_empty(g), point(moment("x"), moment("y"), g["srid"]))


def point_distance(a: Column, b: Column) -> Column:
    return F.hypot(get_x(a) - get_x(b), get_y(a) - get_y(b))


def _angle(s: Column) -> Column:
    return F.degrees(F.atan2(s["b"]["y"] - s["a"]["y"], s["b"]["x"] - s["a"]["x"]))


def start_angle(g: Column) -> Column:
    """Direction of the first segment, degrees counter-clockwise from east."""
    return _let(F.get(segments(vertices(g)), F.lit(0)), _angle)


def end_angle(g: Column) -> Column:
    return _let(F.try_element_at(segments(vertices(g)), F.lit(-1)), _angle)


# --- comparison and movement ---

def equals_exact(a: Column, b: Column) -> Column:
    return (a["kind"] == b["kind"]) & (a["parts"] == b["parts"])


def equals_exact_tolerance(a: Column, b: Column, tolerance) -> Column:
    """Same structure, and each vertex within `tolerance` of its counterpart."""
    sizes = [F.transform(g["parts"], lambda m: F.transform(m, lambda r: F.size(r))) for g in (a, b)]
    near = F.forall(F.zip_with(vertices(a), vertices(b), lambda v, w: F.hypot(v["x"] - w["x"], v["y"] - w["y"])),
                    lambda d: F.coalesce(d <= _c(tolerance), F.lit(False)))
    return (a["kind"] == b["kind"]) & (sizes[0] == sizes[1]) & near


def _moved(g: Column, move, srid=None) -> Column:
    parts = F.transform(g["parts"], lambda m: F.transform(m, lambda r: F.transform(r, move)))
    return make(g["kind"], parts, g["srid"] if srid is None else srid)


def offset(g: Column, dx, dy) -> Column:
    return _moved(g, lambda v: F.struct((v["x"] + _c(dx)).alias("x"), (v["y"] + _c(dy)).alias("y")))


def reproject(g: Column, target: int) -> Column:
    """Every vertex between 4326 and 3857; null for any other reference system."""
    move = to_mercator if target == 3857 else from_mercator
    source = 4326 if target == 3857 else 3857

    def shift(v: Column) -> Column:
        x, y = move(v["x"], v["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.when(g["srid"] == target, g).when(g["srid"] == source, _moved(g, shift, target))


# --- point against polygon, without leaving the JVM ---

NEAR = 1e-11  # as a share of the coordinates: what is nearer to a line counts as on it, here and in the general test


def _on_segment(x: Column, y: Column, s: Column) -> Column:
    a, b = s["a"], s["b"]
    reach = NEAR * F.greatest(F.lit(1.0), *[F.abs(c) for c in (x, y, a["x"], a["y"], b["x"], b["y"])])
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return ((F.abs(dx * (y - a["y"]) - dy * (x - a["x"])) <= reach * F.hypot(dx, dy))
            & x.between(F.least(a["x"], b["x"]) - reach, F.greatest(a["x"], b["x"]) + reach)
            & y.between(F.least(a["y"], b["y"]) - reach, F.greatest(a["y"], b["y"]) + reach))


def locate_point(x: Column, y: Column, g: Column) -> Column:
    """1 inside, 0 on the boundary, -1 outside a polygon (holes and members count by parity)."""
    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (
            x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    rings = F.flatten(g["parts"])
    on = F.exists(rings, lambda r: F.exists(segments(r), lambda s: _on_segment(x, y, s)))
    hits = F.aggregate(rings, F.lit(0), lambda acc, r: acc + F.size(F.filter(segments(r), crosses)))
    return F.when(on, 0).when(hits % 2 == 1, 1).otherwise(-1)


def point_to_geometry(x: Column, y: Column, g: Column) -> Column:
    """Distance from a position to a geometry, 0 inside a polygon."""
    def to_segment(s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        along = ((x - s["a"]["x"]) * dx + (y - s["a"]["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
        return _let(F.least(F.greatest(F.coalesce(along, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), lambda t: F.hypot(
            x - s["a"]["x"] - t * dx, y - s["a"]["y"] - t * dy))

    lines = F.array_min(F.transform(F.flatten(g["parts"]), lambda r: F.array_min(F.transform(segments(r), to_segment))))
    spots = F.array_min(F.transform(vertices(g), lambda v: F.hypot(x - v["x"], y - v["y"])))
    inside = (dimension(g) == 2) & (locate_point(x, y, g) >= 0)
    return F.when(inside, 0.0).when(dimension(g) > 0, F.coalesce(lines, spots)).otherwise(spots)
