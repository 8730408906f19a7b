"""Aggregates, classification and grids over whole collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.functions.registry import table_call
from geoloom.operators import classes, collections as co, grids, ordering
from suite.registry import query
from suite.shapes import boxes, zones


@query("""
select locator, count(value) as count, round(sum(value), 4) as sum, round(avg(value), 9) as average, min(value) as min,
  max(value) as max, round(stddev_samp(value), 5) as std_dev, count(distinct value) as "distinct", round(quantile_cont(value, 0.5), 9) as median
from f_points group by locator""")
def aggregate(t):
    out = co.aggregate(t("f_points"), "value", ["count", "sum", "average", "min", "max", "std_dev", "distinct", "median"], ["locator"])
    return out.select("locator", "count", "min", "max", "distinct", F.round("median", 9).alias("median"),
                      F.round("sum", 4).alias("sum"), F.round("average", 9).alias("average"), F.round("std_dev", 5).alias("std_dev"))


@query("""
select count(value) as count, round(sum(value), 4) as sum, round(avg(value), 6) as average, min(value) as min, max(value) as max,
  round(quantile_cont(value, 0.5), 9) as median, min(x) as minX, max(x) as maxX, min(y) as minY, max(y) as maxY from f_points""")
def collection_aggregates(t):
    """Count, sum, average, extremes, median and bounds of one collection."""
    p = t("f_points")
    out = co.aggregate(p, "value", ["count", "sum", "average", "min", "max", "median"])
    box = co.collection_bounds(p.select("id", "x", "y")).select(F.struct("*")).scalar()
    return out.withColumn("b", box).select(
        "count", F.round("sum", 4).alias("sum"), F.round("average", 6).alias("average"), "min", "max",
        F.round("median", 9).alias("median"), "b.*")


@query("select count(*) as count from f_points")
def count_features(t):
    return table_call("Count", t("f_points"))


@query("select distinct value from f_points")
def unique_values(t):
    return co.unique(t("f_points"), "value")


@query("""select id, locator, value, null as cx from f_sites union all select id, locator, null, cx from f_zones""")
def union_collections(t):
    return co.union_collections(t("f_sites").select("id", "locator", "value"), t("f_zones").select("id", "locator", "cx"))


@query("""
select locator, cast(p as double) as prob, round(quantile_cont(value, p), 9) as quantile from f_points, (values (0.1), (0.5), (0.9)) v(p)
group by locator, p""".replace("quantile_cont(value, p)", """case p when 0.1 then quantile_cont(value, 0.1)
   when 0.5 then quantile_cont(value, 0.5) else quantile_cont(value, 0.9) end"""))
def exact_quantiles(t):
    out = ordering.exact_quantiles(t("f_points"), "value", [0.1, 0.5, 0.9], ["locator"])
    return out.select("locator", "prob", F.round("quantile", 9).alias("quantile"))


def _classes(t, breaks):
    rows = t("f_points").select("id", "value")
    return classes.classify(rows, "value", breaks)


@query("""
select id, cast(least(4, floor((value - lo) / ((hi - lo) / 5))) as int) as class from f_points, (select min(value) as lo, max(value) as hi from f_points)""")
def classify_equal_interval(t):
    return _classes(t, classes.equal_interval(t("f_points"), "value", 5)).select("id", "class")


@query("""
select id, (value >= q1)::int + (value >= q2)::int + (value >= q3)::int as class from f_points, (
  select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as q2, quantile_cont(value, 0.75) as q3 from f_points)""")
def classify_quantile(t):
    return _classes(t, classes.quantile(t("f_points"), "value", 4)).select("id", "class")


@query("""
select id, (value >= m - d)::int + (value >= m)::int + (value >= m + d)::int as class from f_points, (
  select avg(value) as m, stddev_pop(value) as d from f_points)""")
def classify_standard_deviation(t):
    return _classes(t, classes.standard_deviation(t("f_points"), "value", 4)).select("id", "class")


@query("""
select id, (value >= q1)::int + (value >= q2)::int as class from f_points, (
  select quantile_cont(value, cast(1 as double) / 3) as q1, quantile_cont(value, cast(2 as double) / 3) as q2 from (select distinct value from f_points))""")
def classify_unique_interval(t):
    return _classes(t, classes.unique_interval(t("f_points"), "value", 3)).select("id", "class")


@query()
def classify_jenks(t):
    return _classes(t, classes.jenks(t("f_points"), "value", 5)).groupBy("class").agg(
        F.count(F.lit(1)).alias("count"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("""
select cast(floor(x / 10) as bigint) as cx, cast(floor(y / 10) as bigint) as cy, count(*) as count, count(distinct (x, y)) as unique_count,
  round(avg(x), 6) as x, round(avg(y), 6) as y from f_sites group by 1, 2""")
def point_stacker(t):
    out = grids.point_stacker(t("f_sites"), 10.0)
    return out.select("cx", "cy", "count", "unique_count", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""
with cells as (select cast(floor(x / 10) as bigint) as cx, cast(floor(y / 10) as bigint) as cy, sum(value) as w from f_sites group by 1, 2),
steps as (select unnest(range(-2, 3)) as d),
kernel as (select a.d as dx, b.d as dy, pow(1 - (a.d * a.d + b.d * b.d) / 9.0, 2) as k from steps a, steps b where a.d * a.d + b.d * b.d < 9),
spread as (select cx + dx as cx, cy + dy as cy, sum(w * k) as density from cells, kernel group by 1, 2)
select cx, cy, round(density, 4) as density, round(density / (select max(density) from spread), 6) as intensity from spread""")
def heatmap(t):
    out = grids.heatmap(t("f_sites"), 10.0, 2, "value")
    return out.select("cx", "cy", F.round("density", 4).alias("density"), F.round("intensity", 6).alias("intensity"))


@query("""
select id, c.i as col, r.i as "row", minx + c.i * 0.5 as x, miny + r.i * 0.5 as y, cast(0.25 as double) as area
from f_geometadata, (select unnest(range(100)) as i) c, (select unnest(range(100)) as i) r
where c.i < ceil((maxx - minx) / 0.5) and r.i < ceil((maxy - miny) / 0.5)""")
def grid_cells(t):
    out = grids.grid_cells(boxes(t), 0.5)
    return out.select("id", "col", "row", g.get_x(F.col("geom")).alias("x"), g.get_y(F.col("geom")).alias("y"),
                      g.area(F.col("geom")).alias("area"))


@query("""
select id, 9 as points, round(0.5 * 8 * 4 * sin(2 * pi() / 8), 6) as area, x + 2 as east, y as centre_y from f_sites""")
def point_buffers(t):
    out = co.point_buffers(t("f_sites").select("id", "x", "y"), 2.0, 8)
    geom = F.col("geom")
    return out.select("id", g.num_points(geom).alias("points"), F.round(g.area(geom), 6).alias("area"),
                      g.get_x(geom).alias("east"), F.round(g.get_y(g.centroid(geom)), 6).alias("centre_y"))


@query("""select locator, 'MULTIPOINT' as kind, count(*) as members, min(x) as minx, max(y) as maxy from f_sites group by locator""")
def collect_geometries(t):
    rows = t("f_sites").select("id", "locator", g.point("x", "y").alias("geom"))
    out = co.collect_geometries(rows, ["locator"])
    e = g.envelope(F.col("geom"))
    return out.groupBy("locator").agg(
        F.min(F.col("geom")["kind"]).alias("kind"), F.sum(g.num_geometries(F.col("geom"))).alias("members"),
        F.min(e["minX"]).alias("minx"), F.max(e["maxY"]).alias("maxy"))


@query("""
with spots as (select distinct locator, round(x * 100) as x, round(y * 100) as y from f_points),
sides as (select a.locator, a.x as ax, a.y as ay, b.x as bx, b.y as by_,
   min((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) as leftmost,
   bool_or((b.x - a.x) * (p.y - a.y) = (b.y - a.y) * (p.x - a.x) and (p.x - a.x) * (p.x - b.x) + (p.y - a.y) * (p.y - b.y) > 0) as goes_on
   from spots a join spots b on a.locator = b.locator and (a.x <> b.x or a.y <> b.y) join spots p on p.locator = a.locator
   group by a.locator, a.x, a.y, b.x, b.y)
select locator, cast(count(*) + 1 as integer) as points, round(sum(ax * by_ - bx * ay) / 20000, 6) as area from sides where leftmost >= 0 and not goes_on group by locator""")
def convex_hull(t):
    """Corners and area: a side of the hull has all other points on its left. Whole hundredths tell points on a side exactly."""
    out = co.convex_hull(t("f_points").select("locator", F.round(F.col("x") * 100).alias("x"), F.round(F.col("y") * 100).alias("y")))
    return out.select("locator", g.num_points(F.col("geom")).alias("points"), F.round(g.area(F.col("geom")) / 10000, 6).alias("area"))


@query("""
select id, round((cx + r) * pi() / 180 * 6378137.0, 3) as x, round(cx + r, 9) as back_x, round(cy, 9) as back_y, 3857 as srid from f_zones""")
def reproject_features(t):
    """Every vertex to web mercator, and back again."""
    out = zones(t).withColumn("geom", g.reproject(F.col("geom"), 3857))
    out = out.withColumn("back", g.reproject(F.col("geom"), 4326))
    back = F.col("back")
    return out.select("id", F.round(g.get_x(F.col("geom")), 3).alias("x"), F.round(g.get_x(back), 9).alias("back_x"),
                      F.round(g.get_y(back), 9).alias("back_y"), F.col("geom.srid").alias("srid"))


@query("""
with keyed as (select case when id % 7 = 0 then null else locator end as locator, value from f_points)
select locator, count(value) as count, round(quantile_cont(value, 0.5), 9) as median from keyed group by locator""")
def aggregate_with_null_key(t):
    keyed = t("f_points").withColumn("locator", F.when(F.col("id") % 7 != 0, F.col("locator")))
    return co.aggregate(keyed, "value", ["count", "median"], ["locator"]).withColumn("median", F.round("median", 9))


@query("select id, locator, ts, x, y, value from f_points where value > 5")
def query_all_features(t):
    return co.query_features(t("f_points"), F.col("value") > 5)
