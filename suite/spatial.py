"""Spatial filters and joins over points, boxes and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.operators import collections as co
from geoloom.operators import nearest as nn
from geoloom.operators import relate as rel
from geoloom.operators import spatial as sp
from suite.registry import query
from suite.shapes import boxes, lines, solid_zones, zones

MEET = "a.minx <= b.maxx and a.maxx >= b.minx and a.miny <= b.maxy and a.maxy >= b.miny"
SHARE = "a.minx < b.maxx and a.maxx > b.minx and a.miny < b.maxy and a.maxy > b.miny"
INSIDE = "a.minx >= b.minx and a.maxx <= b.maxx and a.miny >= b.miny and a.maxy <= b.maxy"
AROUND = "a.minx <= b.minx and a.maxx >= b.maxx and a.miny <= b.miny and a.maxy >= b.maxy"
PAIRS = "from f_geometadata a join f_geometadata b on "


def _told(lists, names):
    """A row for each predicate that holds between the rows of a pair; those listed on the left are paired when it is named."""
    held = F.array_compact(F.array(*[F.when(F.col(n), n) for n in names]))
    named = sp.each_pair(lists, [], ["r_id", *names]).select(F.explode(held).alias("predicate"), F.col("l_id").alias("a"), F.col("r_id").alias("b"))
    return sp.each_pair(named, ["a"], [])


@query("select id, minx, maxx, miny, maxy from f_geometadata where minx <= 20 and maxx >= -35.5 and miny <= 40 and maxy >= -12")
def bbox_filter(t):
    return sp.bbox_filter(boxes(t), -35.5, -12, 20, 40)


@query("select id, x, y from f_sites where x between -20 and 35.5 and y between -12 and 40")
def rectangular_clip(t):
    return co.clip(t("f_sites").select("id", "x", "y"), -20, -12, 35.5, 40)


@query(f"""
select 'intersects' as predicate, a.id as a, b.id as b {PAIRS} {MEET}
union all select 'within', a.id, b.id {PAIRS} {INSIDE}
union all select 'contains', a.id, b.id {PAIRS} {AROUND}
union all select 'equals', a.id, b.id {PAIRS} {INSIDE} and {AROUND}
union all select 'touches', a.id, b.id {PAIRS} {MEET} and not ({SHARE})
union all select 'overlaps', a.id, b.id {PAIRS} {SHARE} and not ({INSIDE}) and not ({AROUND})""")
def spatial_join_boxes(t):
    """Every predicate between boxes, each pair related once."""
    names = ["intersects", "within", "contains", "equals", "touches", "overlaps"]
    return _told(sp.spatial_join(boxes(t), boxes(t), keep=["l_id", "r_id"], also=names, listed=True), names)


@query("""select p.id as point, b.id as box, p.x > b.minx and p.x < b.maxx and p.y > b.miny and p.y < b.maxy as inside
from f_points p join f_geometadata b on p.x between b.minx and b.maxx and p.y between b.miny and b.maxy""")
def spatial_join_points_boxes(t):
    pairs = sp.spatial_join(t("f_points").select("id", "x", "y"), boxes(t))
    return pairs.select(F.col("l_id").alias("point"), F.col("r_id").alias("box"),
                        sp.exact_test("within", "point", "box").alias("inside"))


REACH = "abs(p.x - z.cx) + abs(p.y - z.cy)"
IN_ZONES = f"f_sites p join f_zones z on {REACH} <= z.r and {REACH} >= z.r / 2"


@query(f"select p.id as point, z.id as zone, {REACH} < z.r and {REACH} > z.r / 2 as inside, {REACH} in (z.r, z.r / 2) as edge from {IN_ZONES}")
def spatial_join_points_polygons(t):
    """Points in polygons with holes, decided block by block."""
    pairs = sp.spatial_join(t("f_sites").select("id", "x", "y"), zones(t), keep=["l_id", "r_id"], also=("within", "touches"))
    return pairs.select(F.col("l_id").alias("point"), F.col("r_id").alias("zone"), F.col("within").alias("inside"), F.col("touches").alias("edge"))


# Two diamonds are boxes in the turned coordinates x + y and x - y.
TURNED = "(select id, cx+cy-r as minx, cx+cy+r as maxx, cx-cy-r as miny, cx-cy+r as maxy from f_zones)"
TURNED_PAIRS = f"from {TURNED} a join {TURNED} b on "


@query(f"""
select 'intersects' as predicate, a.id as a, b.id as b {TURNED_PAIRS} {MEET}
union all select 'within', a.id, b.id {TURNED_PAIRS} {INSIDE}
union all select 'contains', a.id, b.id {TURNED_PAIRS} {AROUND}
union all select 'equals', a.id, b.id {TURNED_PAIRS} {INSIDE} and {AROUND}
union all select 'touches', a.id, b.id {TURNED_PAIRS} {MEET} and not ({SHARE})
union all select 'overlaps', a.id, b.id {TURNED_PAIRS} {SHARE} and not ({INSIDE}) and not ({AROUND})""")
def spatial_join_polygons(t):
    """Every predicate between polygons, each pair related once."""
    told = [n for n in rel.PREDICATES if n != "disjoint"]
    return _told(sp.spatial_join(solid_zones(t), solid_zones(t), keep=["l_id", "r_id"], also=told, listed=True), told)


# A level line of two vertices against a diamond: what it has inside is an open stretch around the diamond's middle.
HALF = "(z.r - abs(s.y - z.cy))"


@query(f"""
select s.id as line, z.id as zone from (select id, x, y, 0.375 + id % 9 * 0.5 as reach from f_sites) s join f_zones z
on {HALF} > 0 and s.x < z.cx + {HALF} and s.x + s.reach > z.cx - {HALF} and (s.x < z.cx - {HALF} or s.x + s.reach > z.cx + {HALF})""")
def spatial_join_crosses(t):
    """Lines that cross polygons."""
    reach = F.col("x") + 0.375 + F.col("id") % 9 * 0.5
    level = t("f_sites").withColumn("geom", g.line(F.array(g.vertex(F.col("x"), F.col("y")), g.vertex(reach, F.col("y"))))).select("id", "geom")
    return sp.spatial_join(level, solid_zones(t), "crosses", ["l_id", "r_id"]).select(F.col("l_id").alias("line"), F.col("r_id").alias("zone"))


TURNED_GAP = """sqrt((pow(greatest(a.minx - b.maxx, b.minx - a.maxx, 0), 2) + pow(greatest(a.miny - b.maxy, b.miny - a.maxy, 0), 2)) / 2)"""


@query(f"select a.id as a, b.id as b, round({TURNED_GAP}, 6) as distance {TURNED_PAIRS} {TURNED_GAP} <= 1.61803")
def distance_join_polygons(t):
    """Polygons that meet or lie apart, with their distances."""
    near = sp.distance_join(solid_zones(t), solid_zones(t), 1.61803, ["l_id", "r_id"])
    return near.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.round("distance", 6).alias("distance"))


@query()
def spatial_join_lines_polygons(t):
    """Lines crossing polygons with holes."""
    pairs = sp.spatial_join(lines(t).select("id", "geom"), zones(t).select("id", "geom"), "crosses", ["l_id", "r_id"])
    return pairs.select(F.col("l_id").alias("line"), F.col("r_id").alias("zone"))


@query(f"select id from f_sites where id not in (select p.id from {IN_ZONES})")
def spatial_disjoint(t):
    return sp.spatial_semi(t("f_sites").select("id", "x", "y"), zones(t), "disjoint").select("id")


@query("select id, x, y, abs(x - 10) + abs(y - 5) < 40 as inside from f_sites where abs(x - 10) + abs(y - 5) <= 40")
def spatial_filter(t):
    """Points in one constant diamond."""
    ring = F.array(*[g.vertex(F.lit(10.0 + dx), F.lit(5.0 + dy)) for dx, dy in ((40, 0), (0, 40), (-40, 0), (0, -40), (40, 0))])
    rows = t("f_sites").select("id", "x", "y")
    within = sp.spatial_filter(rows, "within", g.polygon(ring), (-30, -35, 50, 45)).select("id", F.lit(True).alias("inside"))
    return sp.spatial_filter(rows, "intersects", g.polygon(ring), (-30, -35, 50, 45)).join(
        within, "id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


GAP = """sqrt(pow(greatest(a.minx - b.maxx, b.minx - a.maxx, 0), 2) + pow(greatest(a.miny - b.maxy, b.miny - a.maxy, 0), 2))"""


@query(f"select a.id as a, b.id as b, round({GAP}, 9) as distance from f_geometadata a join f_geometadata b on {GAP} <= 2.5")
def distance_join(t):
    near = sp.distance_join(boxes(t), boxes(t), 2.5)
    return near.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.round("distance", 9).alias("distance"))


# Two lines of the same three-vertex shape: their distance is checked against brute force in tests.
@query()
def distance_join_geometries(t):
    near = sp.distance_join(zones(t), lines(t).select("id", "geom"), 0.5, ["l_id", "r_id"])
    return near.select(F.col("l_id").alias("zone"), F.col("r_id").alias("line"), F.round("distance", 6).alias("distance"))


@query("""select id from f_sites p where not exists (select 1 from f_geometadata b
  where sqrt(pow(greatest(p.x - b.maxx, b.minx - p.x, 0), 2) + pow(greatest(p.y - b.maxy, b.miny - p.y, 0), 2)) <= 1.5)""")
def beyond(t):
    return sp.beyond(t("f_sites").select("id", "x", "y"), boxes(t), 1.5).select("id")


@query("""
select id, n.nearest_id, round(sqrt(n.d2), 9) as distance from f_points p, lateral (
  select q.id as nearest_id, pow(p.x - q.x, 2) + pow(p.y - q.y, 2) as d2
  from (select doc_id as id, cast(doc_id*37%1440 as double)/4-180 as x, cast(doc_id*53%720 as double)/4-90 as y from documents) q
  order by d2, q.id limit 1) n""")
def nearest_join(t):
    sites = t.sql("""select doc_id as id, cast(doc_id*37%1440 as double)/4-180 as x,
        cast(doc_id*53%720 as double)/4-90 as y from {documents}""")
    out = nn.nearest_join(t("f_points").select("id", "x", "y"), sites)
    return out.select("id", "nearest_id", F.round("distance", 9).alias("distance"))


@query("""
select id, round(sqrt(pow(x - 12.3, 2) + pow(y + 4.5, 2)), 9) as distance from f_points
order by pow(x - 12.3, 2) + pow(y + 4.5, 2), id limit 1""")
def nearest(t):
    one = nn.nearest(t("f_points").select("id", "x", "y"), 12.3, -4.5)
    return one.select("id", F.round("distance", 9).alias("distance"))


@query()
def snap(t):
    moved = nn.snap(t("f_points").select("id", "x", "y"), zones(t))
    return moved.select("id", "nearest_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("distance", 6).alias("distance"))


@query(f"select distinct p.id, p.value from {IN_ZONES} where {REACH} < z.r and {REACH} > z.r / 2")
def inclusion_collection(t):
    return co.inclusion_collection(t("f_sites").select("id", "value", "x", "y"), zones(t)).select("id", "value")


@query(f"select p.id as point, p.value, z.id as zone, z.locator as zone_locator, p.x, p.y from {IN_ZONES}")
def intersection_collection(t):
    pairs = co.intersection_collection(t("f_sites").select("id", "value", "x", "y"), zones(t))
    return pairs.select(F.col("l_id").alias("point"), F.col("l_value").alias("value"), F.col("r_id").alias("zone"),
                        F.col("r_locator").alias("zone_locator"), F.col("l_x").alias("x"), F.col("l_y").alias("y"))


@query(f"""
select z.id, coalesce(s.n, 0) as count, s.low as min, s.high as max, round(s.total, 6) as sum, round(s.mean, 6) as avg, round(s.dev, 6) as stddev
from f_zones z left join (select z.id, count(p.value) as n, min(p.value) as low, max(p.value) as high, sum(p.value) as total,
   avg(p.value) as mean, stddev_pop(p.value) as dev from {IN_ZONES} group by z.id) s using (id)""")
def zonal_statistics(t):
    stats = co.zonal_statistics(t("f_sites").select("id", "value", "x", "y"), zones(t), "value")
    return stats.select("id", "count", "min", "max", *[F.round(c, 6).alias(c) for c in ("sum", "avg", "stddev")])


@query("""
select a.id, b.id as other, false as disjoint, true as intersects, a.cx = b.cx and a.cy = b.cy and a.r = b.r as same, cast(0 as double) as distance, true as near
from f_zones a join f_zones b on abs((a.cx + a.cy) - (b.cx + b.cy)) <= a.r + b.r and abs((a.cx - a.cy) - (b.cx - b.cy)) <= a.r + b.r""")
def fn_predicates(t):
    """The published predicates and distances, on candidate pairs; rows of equal geometries come as lists until these are told."""
    from geoloom.functions.registry import call
    pairs = sp.candidate_pairs(solid_zones(t), solid_zones(t), by_shape=True)
    a, b = F.col("l_geom"), F.col("r_geom")
    told = pairs.filter(call("intersects", a, b)).select(
        F.col("l_id").alias("id"), F.col("r_id").alias("other"), call("disjoint", a, b).alias("disjoint"),
        call("intersects", a, b).alias("intersects"), (call("contains", a, b) & call("within", a, b)).alias("same"),
        call("distance", a, b).alias("distance"), call("isWithinDistance", a, b, 0.1).alias("near"))
    return sp.each_pair(told, ["id"], ["other"])


# Boxes of 1000 km and sites in metres.
WIDE = "cast(doc_id * 37 % 340 - 170 as double) * 100000 as minx, cast(doc_id * 53 % 160 - 80 as double) * 100000 as miny"


@query(f"""
with w as (select doc_id as id, {WIDE} from documents)
select w.id, count(*) as sites from w join f_sites s on s.x * 100000 between w.minx and w.minx + 1000000 and s.y * 100000 between w.miny and w.miny + 1000000
group by w.id""")
def spatial_join_wide_boxes(t):
    wide = t("documents").selectExpr("doc_id as id", *WIDE.split(", ")).withColumns({"maxx": F.col("minx") + 1e6, "maxy": F.col("miny") + 1e6})
    sites = t("f_sites").select("id", (F.col("x") * 100000).alias("x"), (F.col("y") * 100000).alias("y"))
    lists = sp.spatial_join(sites, wide, keep=["l_id", "r_id"], listed=True)
    return lists.select(F.explode("r_id").alias("id"), F.size("l_id").alias("sites")).groupBy("id").agg(F.sum("sites").alias("sites"))


# All sites and boxes inside a quarter degree.
DENSE = "0.25 * (id * 37 % 1440) / 1440 as x, 0.25 * (id * 53 % 720) / 720 as y"
DENSE_BOX = "0.25 * (doc_id * 37 % 340) / 340 as minx, 0.25 * (doc_id * 53 % 160) / 160 as miny, 0.002 + 0.001 * (doc_id % 3) as side"


@query(f"""
select p.id as point, b.id as box from (select id, {DENSE} from f_sites) p join (select doc_id as id, {DENSE_BOX} from documents) b
on p.x between b.minx and b.minx + b.side and p.y between b.miny and b.miny + b.side""")
def spatial_join_crowded(t):
    exact = lambda text: [f"{e.rsplit(' as ', 1)[0].replace('0.25', '0.25D').replace('0.002', '0.002D').replace('0.001', '0.001D')} as {e.rsplit(' as ', 1)[1]}" for e in text.split(", ")]
    sites = t("f_sites").selectExpr("id", *exact(DENSE))
    crowd = t("documents").selectExpr("doc_id as id", *exact(DENSE_BOX)).selectExpr("id", "minx", "minx + side as maxx", "miny", "miny + side as maxy")
    return sp.spatial_join(sites, crowd).select(F.col("l_id").alias("point"), F.col("r_id").alias("box"))


@query("""
with upright as (select id, x, y - id % 3 * 0.5 as low from f_sites where id % 7 > 2)
select a.id as a, b.id as b, a.y > b.low and a.y < b.low + 1 as crosses from (select id, x, y from f_sites where id % 7 < 3) a
join upright b on a.x = b.x and a.y between b.low and b.low + 1""")
def flat_boxes(t):
    """Level against upright lines, as boxes without area."""
    spots = t("f_sites").select("id", "x", "y")
    level = spots.filter("id % 7 < 3").selectExpr("id", "x - 0.125D as minx", "x + 0.125D as maxx", "y as miny", "y as maxy")
    upright = spots.filter("id % 7 > 2").selectExpr("id", "x as minx", "x as maxx", "y - id % 3 * 0.5D as miny", "y - id % 3 * 0.5D + 1 as maxy")
    return sp.spatial_join(level, upright, keep=["l_id", "r_id"], also=("crosses",)).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), "crosses")
