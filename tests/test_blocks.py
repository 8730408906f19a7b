"""Joins with geometries block by block: right pairs, whatever the blocks, and none of them shuffled."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.operators import blocks, collections, relate, spatial


def shapes(table, n, seed):
    """Boxes, lines and diamonds of many sizes, some of them several times, and a null one."""
    draw = random.Random(seed)
    some = [f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))" if draw.random() < 0.5 else f"LINESTRING ({x} {y}, {x + w} {y + h}, {x + w} {y - h})"
            for x, y, w, h in ([draw.randrange(-40, 40) / 4, draw.randrange(-40, 40) / 4, draw.choice([0.25, 1, 7, 30]), draw.choice([0.25, 2, 9])] for _ in range(n // 2))]
    big = f"POLYGON ((-9 -9, {seed + 3} -9, {seed + 3} 9, -9 9, -9 -9))"
    made = [(i, draw.choice(some)) for i in range(n)] + [(n, None), (n + 1, big)]
    return table("id long, wkt string", *made).select("id", g.from_wkt(F.col("wkt")).alias("geom")).checkpoint()


@pytest.mark.parametrize("block_rows", [7, 20_000])
def test_blocks_equal_every_pair(table, block_rows):
    a, b = shapes(table, 60, 1), shapes(table, 50, 2)
    every = a.select(F.col("id").alias("l_id"), F.col("geom").alias("p")).crossJoin(b.select(F.col("id").alias("r_id"), F.col("geom").alias("q")))
    bits = {(r.l_id, r.r_id): r.bits for r in every.select("l_id", "r_id", relate.relation(F.col("p"), F.col("q")).alias("bits")).collect()}
    want = {n: sorted(k for k, v in bits.items() if v is not None and v >> i & 1) for i, n in enumerate(relate.PREDICATES)}
    others = ("within", "touches", "crosses", "overlaps")
    got = spatial.spatial_join(a, b, "intersects", also=others, hot_rows=block_rows).checkpoint()
    assert got.columns == [*[p + c for p in ("l_", "r_") for c in ("id", "geom", "minx", "maxx", "miny", "maxy")], *others]
    assert rows(got.select("l_id", "r_id"), "l_id", "r_id") == want["intersects"] and want["intersects"]
    for n in others:
        assert rows(got.filter(n).select("l_id", "r_id"), "l_id", "r_id") == want[n] and want[n]
    own = got.join(a.select(F.col("id").alias("l_id"), F.col("geom").alias("g")), "l_id")
    assert own.filter(F.col("g.parts") == F.col("l_geom.parts")).count() == len(want["intersects"])
    assert rows(spatial.spatial_semi(a, b, "within", hot_rows=block_rows).select("id"), "id") == sorted({(i,) for i, _ in want["within"]})


@pytest.mark.parametrize("block_rows", [9, 20_000])
def test_points_in_blocks_equal_the_columns(table, block_rows):
    draw = random.Random(5)
    spots = [(i, draw.randrange(-30, 30) / 4, draw.randrange(-30, 30) / 4, draw.choice([None, float("nan"), 1.5, 2.0, 1e9 + i])) for i in range(200)]
    points, zones = table("id long, x double, y double, value double", *spots), shapes(table, 40, 7)
    points = points.checkpoint()
    pairs = points.crossJoin(zones.withColumnsRenamed({"id": "zone"})).withColumn("place", spatial._place_point(F.col("x"), F.col("y"), F.col("geom"))).checkpoint()
    want = rows(pairs.filter("place >= 0").select("id", "zone", F.col("place") == 1, F.col("place") == 0), "id", "zone")
    got = spatial.spatial_join(points, zones, keep=["l_id", "r_id"], also=("within", "touches"), hot_rows=block_rows)
    assert rows(got, "l_id", "r_id") == want and want
    v = F.col("value")
    stats = pairs.filter("place >= 0").groupBy(F.col("zone").alias("id")).agg(
        F.count(v), F.min(v), F.max(v), F.sum(v), F.avg(v), F.stddev_pop(v))
    plain = {r[0]: r[1:] for r in stats.collect()}
    for r in collections.zonal_statistics(points, zones, "value", hot_rows=block_rows).collect():
        for mine, theirs in zip(r[1:], plain.get(r.id, (0, *[None] * 5)), strict=True):
            assert mine is theirs if theirs is None else mine == pytest.approx(theirs, nan_ok=True, rel=1e-9)
    near = pairs.withColumn("gap", g.point_to_geometry(F.col("x"), F.col("y"), F.col("geom"))).filter("gap <= 0.75")
    found = {(r.l_id, r.r_id): r.distance for r in spatial.distance_join(points, zones, 0.75, hot_rows=block_rows).collect()}
    assert found == pytest.approx({(r.id, r.zone): r.gap for r in near.collect()})


def test_pairs_are_not_shuffled(spark, table):
    """Thirty copies of a zone on thirty of another give 900 pairs; the shuffles hold 30 rows a side and cell."""
    same = [(i, "POLYGON ((0.1 0.1, 0.9 0.1, 0.9 0.9, 0.1 0.9, 0.1 0.1))") for i in range(30)]
    zones = table("id long, wkt string", *same).select("id", g.from_wkt(F.col("wkt")).alias("geom"))
    for joined in (spatial.spatial_join(zones, zones), spatial.distance_join(zones, zones, 1.0)):
        assert joined.count() == 900
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange" in line and "l_id" in line and "r_id" in line for line in plan.splitlines())


def test_blocks_are_bounded(table):
    """A part of many rows is dealt into shares, and no block holds more than a few shares."""
    spots = table("id long, x double, y double", *[(i, 0.5, 0.5) for i in range(500)])
    zone = table("id long, wkt string", (1, "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))")).select("id", g.from_wkt(F.col("wkt")).alias("geom"))
    placed = blocks._placed(spots, zone, ["l_id", "r_id"], 0.0, 0.25, 20)
    biggest = placed.groupBy(*blocks.PART).count().agg(F.max("count")).first()[0]
    assert biggest < 60 and placed.filter("_side = 0").select("l_id").distinct().count() == 500
