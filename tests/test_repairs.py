"""Cases that once gave wrong rows: nulls, NaN, outliers, flat and very wide boxes, points on edges, long files, hot right sides."""

import math
import random
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.operators import classes, collections as co, folds, ordering, simplify, spatial
from geoloom.operators.relate import PREDICATES, holds
from geoloom.operators.skew import salted_join
from geoloom.sources import blobs


def test_queries_have_no_limit_of_their_own(spark):
    assert co.query_features(spark.range(1_000_050)).count() == 1_000_050
    assert co.query_features(spark.range(20), max_features=7).count() == 7


def test_null_keys_stay(spark, table):
    df = table("k string, v double", (None, 2.0), (None, 4.0), ("a", 1.0))
    assert sorted(map(tuple, co.aggregate(df, "v", ["count", "median"], ["k"]).collect()), key=str) == [("a", 1, 1.0), (None, 2, 3.0)]
    shapes = table("id long, k string", (1, None), (2, "a"), (3, None)).withColumn("geom", g.point(F.col("id"), F.col("id")))
    assert {(r.k, r.n) for r in co.collect_geometries(shapes, ["k"]).select("k", g.num_geometries(F.col("geom")).alias("n")).collect()} == {(None, 2), ("a", 1)}
    assert sorted(r.id for r in folds.assign_ids(table("k string", (None,), ("x",), ("y",)), "k").collect()) == [1, 2, 3]


def test_nan_is_the_largest_value(spark, table):
    df = table("v double", (1.0,), (math.nan,), (3.0,), (None,), (2.0,))
    got = {r.prob: r.quantile for r in ordering.exact_quantiles(df, "v", [0.0, 1 / 3, 1.0]).collect()}
    assert got[0.0] == 1.0 and got[1 / 3] == pytest.approx(2.0) and math.isnan(got[1.0])


def test_natural_breaks_with_an_outlier(spark):
    df = spark.range(5000).select(F.when(F.col("id") == 17, 1e9).otherwise(F.col("id").cast("double")).alias("v"))
    breaks = classes.jenks(df, "v", 4).first().breaks
    assert len(breaks) == 5 and breaks[0] == 0.0 and breaks[3] == 4999.0 and breaks[4] == 1e9 and breaks == sorted(set(breaks))
    few = spark.range(30).select((F.col("id") % 3 * 10).cast("double").alias("v"))
    assert classes.jenks(few, "v", 3).first().breaks == [0.0, 0.0, 10.0, 20.0]


def test_one_rule_for_points_on_edges(spark, table):
    zone = table("id long", (1,)).withColumn("geom", g.from_wkt(F.lit("POLYGON ((0 0, 1 3, 5 0, 0 0))")))
    spot = table("id long, x double, y double", (1, 0.1, 0.3))
    shape = spot.select("id", g.point(F.col("x"), F.col("y")).alias("geom"))
    for predicate in ("touches", "intersects"):
        assert spatial.spatial_join(spot, zone, predicate).count() == spatial.spatial_join(shape, zone, predicate).count() == 1
    assert spatial.spatial_join(spot, zone, "within").count() == spatial.spatial_join(shape, zone, "within").count() == 0


def test_boxes_without_area(spark):
    draw = random.Random(3)
    span = lambda: sorted(draw.choices(range(4), k=2))
    boxes = spark.createDataFrame([tuple(map(float, (*span(), *span(), *span(), *span()))) for _ in range(400)], ", ".join(
        f"{p}{c} double" for p in ("l_", "r_") for c in ("minx", "maxx", "miny", "maxy")))

    def shape(p):
        x1, x2, y1, y2 = (F.col(p + c) for c in ("minx", "maxx", "miny", "maxy"))
        line = g.line(F.array(g.vertex(x1, y1), g.vertex(x2, y2)))
        return F.when((x1 == x2) & (y1 == y2), g.point(x1, y1)).when((x1 == x2) | (y1 == y2), line).otherwise(g.box(x1, y1, x2, y2))

    for predicate in PREDICATES:
        both = boxes.select("*", spatial._boxes(predicate, "l_", "r_").alias("flat"), holds(predicate, shape("l_"), shape("r_")).alias("general"))
        assert both.filter("flat <> general").limit(3).collect() == [], predicate


def test_wide_boxes_take_few_cells(spark, table):
    wide = spark.range(50).select("id", (F.col("id") * 1e5 - 2e6).alias("minx"), (F.col("id") * 1e5 - 1e6).alias("maxx"), F.lit(-5e5).alias("miny"), F.lit(5e5).alias("maxy"))
    level = spatial._levelled(wide, "l_", spatial.CELL, 0.0)
    assert spatial._in_cells(level, "l_", F.array(F.lit(0)), spatial.CELL).count() <= 4 * 50
    spots = spark.range(200).select("id", (F.col("id") * 2e4 - 2e6).alias("x"), (F.col("id") % 7 * 2e5 - 6e5).alias("y"))
    want = wide.alias("w").crossJoin(spots.alias("s")).filter("s.x between w.minx and w.maxx and s.y between w.miny and w.maxy").count()
    assert spatial.spatial_join(spots, wide, "intersects").count() == want > 0


def test_long_files_are_listed_unread(spark, tmp_path):
    (tmp_path / "long.bin").write_bytes(b"abcdef")
    (tmp_path / "short.bin").write_bytes(b"ab")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 3)  # the source fails where it has to read a longer one
    try:
        got = rows(blobs.scan_blobs(spark, str(tmp_path), longest=3), "locator")
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == [("long.bin", 6, None), ("short.bin", 2, bytearray(b"ab"))]


def test_salted_join_with_a_hot_right_side(spark):
    left = spark.range(300).select("id", (F.col("id") % 3).alias("k"))
    right = spark.range(500).select(F.col("id").alias("other"), F.when(F.col("id") < 400, 1).otherwise(F.col("id") % 3).cast("long").alias("k"))
    out = salted_join(left, right, ["k"], "id", 50, "other")
    assert out.count() == out.select("id", "other").distinct().count() == left.join(right, "k").count()


def test_simplify_is_linear_in_members(spark):
    text = "MULTILINESTRING (" + ", ".join(f"({k} 0, {k} 0.01, {k} 1, {k + 1} 2)" for k in range(10_000)) + ")"
    df = spark.createDataFrame([(1, text)], "id long, wkt string").withColumn("geom", g.from_wkt(F.col("wkt")))
    began = time.time()
    kept = simplify.simplify_features(df, 0.1).select(F.size(g.vertices(F.col("geom"))).alias("n")).first().n
    assert kept == 30_000 and time.time() - began < 60
