"""Steps whose work or memory a task must not grow faster than the rows."""

import random
from types import SimpleNamespace

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from geoloom import fixtures
from geoloom.functions import geometry as g
from geoloom.operators import blocks, nearest, relate, simplify, spatial
from geoloom.plans.simplify import simplify_datasets


def test_leases_go_to_tasks_by_rows(spark, tmp_path, monkeypatch):
    """F16 and others: tasks of the leases' join follow the lines, whatever the number of shuffle partitions."""
    monkeypatch.setattr(fixtures, "ROWS_A_TASK", 50)
    lines = spark.range(1000).selectExpr("id as l_orderkey", "cast(id % 3 as int) as l_linenumber", "timestamp '1995-01-02 00:00:00' as l_shipdate")
    lines.unionByName(lines.limit(10)).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(900).selectExpr("id as o_orderkey", "id % 7 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    leases = fixtures.Tables(spark, str(tmp_path))("f_leases")
    assert leases.count() == leases.select("id").distinct().count() == 900
    assert ", 21), REPARTITION_BY_NUM" in leases._jdf.queryExecution().executedPlan().toString()  # 1010 lines


def test_lines_kept_together_are_kept_alone():
    """the vertices of many lines are judged in rounds, as each line by itself."""
    draw = np.random.default_rng(3)
    sizes = np.array([0, 1, 2, 3, 50, 0, 400, 7, 5])
    x, y = (draw.integers(0, 12, sizes.sum()) / 4 for _ in "xy")
    tol = np.array([0.1, 0.1, 0.3, 0.0, 0.5, 0.1, 1.0, np.nan, 0.25])
    got, at = simplify.keep_masks(x, y, sizes, tol), 0
    for n, t in zip(sizes, tol):
        if n:
            assert (got[at:at + n] == simplify.keep_mask(x[at:at + n], y[at:at + n], t)).all()
        at += n


def test_requests_of_one_tolerance_share_the_work(spark, table, monkeypatch):
    """a feature is thinned once a tolerance, and copied for each request."""
    asked = table("tag string, locator string, seq long, tolerance double", *[(f"t{i}", "ds-1", i, [0.1, 0.4, None][i % 3]) for i in range(30)])
    grants = table("tag string, timeout long, seq long", *[(f"t{i}", 0, i) for i in range(30)])
    feats = table("locator string, id long, wkt string", ("ds-1", 1, "LINESTRING (0 0, 1 0.2, 2 0)"), ("ds-1", 2, None)).select(
        "locator", "id", g.from_wkt(F.col("wkt")).alias("geom"))
    plain = simplify.simplify_features

    def counted(features, tolerance):
        assert features.count() == 4
        return plain(features, tolerance)

    monkeypatch.setattr("geoloom.plans.simplify.simplify_features", counted)
    done = simplify_datasets(asked, grants, feats).features
    found = rows(done.groupBy("id", g.num_points(F.col("geom")).alias("n")).agg(F.count("*"), F.count_distinct("locator")), "id", "n")
    assert [r for r in found if r[0] == 1] == [(1, 2, 10, 10), (1, 3, 20, 20)] and sum(r[2] for r in found if r[0] == 2) == 30


def test_equal_pairs_are_related_once():
    """copies of a pair of shapes cost one test."""
    seen = []

    def test(shapes, a, b):
        seen.append(len(a))
        return relate._relate(shapes, a, b)

    square = lambda x: (2, np.array([0, 1, 1, 0, 0]) + float(x), np.array([0, 0, 1, 1, 0.0]), np.array([5]))
    got = relate.each_pair(test, [(square(0), square(i % 2)) for i in range(100)])
    assert seen == [2] and got[:2] == got[2:4] and got[0] != got[1]


def test_nearest_geometries_in_blocks(table):
    """overlapping geometries, many of them equal, a null one, ties."""
    draw = random.Random(4)
    shapes = [f"POLYGON (({x} {y}, {x + 4} {y}, {x + 4} {y + 4}, {x} {y}))" for x in range(0, 9, 3) for y in range(0, 9, 3)]
    items = table("id long, wkt string", *[(i, shapes[i % 9]) for i in range(60)], (99, None)).select("id", g.from_wkt(F.col("wkt")).alias("geom")).checkpoint()
    spots = table("id long, x double, y double", *[(i, draw.randrange(-20, 80) / 4, draw.randrange(-20, 80) / 4) for i in range(80)]).checkpoint()
    gap = g.point_to_geometry(F.col("x"), F.col("y"), F.col("geom"))
    want = spots.crossJoin(items.select(F.col("id").alias("item"), "geom")).filter("geom is not null").groupBy("id").agg(
        F.min_by("item", F.struct(gap, "item")))
    found = nearest.nearest_join(spots, items)
    assert rows(found.select("id", "nearest_id"), "id") == rows(want, "id")
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def _squares(table, n, copies):
    """Squares side by side, some of them null, each several times; ids repeat and may be null."""
    made = [(i % (n * copies - 5) or None, f"POLYGON (({x} 0, {x + 1} 0, {x + 1} 1, {x} 1, {x} 0))" if x else None) for i in range(n * copies) for x in [i % n]]
    return table("id long, wkt string", *made).select("id", g.from_wkt(F.col("wkt")).alias("geom")).checkpoint()


def test_functions_are_asked_once_for_equal_geometries(table):
    """rows of equal geometries come as lists, so that functions see a pair of geometries once; every pair is there."""
    squares = _squares(table, 6, 40)
    plain = spatial.candidate_pairs(squares, squares).select("l_id", "r_id", F.col("l_geom.parts").alias("p"), F.col("r_geom.parts").alias("q"))
    for block_rows in (20_000, 7):
        listed = spatial.candidate_pairs(squares, squares, by_shape=True, hot_rows=block_rows).checkpoint()
        pairs = spatial.each_pair(listed, ["l_id"], ["r_id"]).select("l_id", "r_id", F.col("l_geom.parts").alias("p"), F.col("r_geom.parts").alias("q"))
        assert rows(pairs.groupBy(*pairs.columns).count().exceptAll(plain.groupBy(*plain.columns).count())) == []
        assert pairs.count() == plain.count() == 13 * 40 * 40
    assert spatial.candidate_pairs(squares, squares, by_shape=True).count() == 13


def test_pairs_come_as_lists(monkeypatch):
    """Python hands over lists of rows, not pairs; every pair is there once, lists are bounded, heavy rows make them short."""
    draw = np.random.default_rng(5)

    def side(units, weight):
        count = draw.integers(1, 40, units)
        return SimpleNamespace(count=count, start=np.cumsum(count) - count, rows=draw.permutation(count.sum()), weight=np.full(units, weight))

    i, j = np.divmod(draw.choice(12 * 9, 60, replace=False), 9)
    for most, weight in ((256, 1), (7, 1), (7, 3), (2, 50)):
        monkeypatch.setattr(blocks, "LIST_ROWS", most)
        a, b = side(12, weight), side(9, 1)
        got, n_lists = [], 0
        for x, nx, y, ny, place in blocks._listed(a, b, i, j):
            assert max(nx) <= max(1, most // weight) and max(ny) < 2 * most
            n_lists += len(nx)
            for l_rows, r_rows, k in zip(np.split(x, np.cumsum(nx)[:-1]), np.split(y, np.cumsum(ny)[:-1]), np.split(place, np.cumsum(ny)[:-1])):
                got += [(p, q, c) for p in l_rows for q, c in zip(r_rows, k)]
        rows_of = lambda s, u: s.rows[s.start[u]:s.start[u] + s.count[u]]
        assert sorted(got) == sorted((p, q, k) for k, (u, v) in enumerate(zip(i, j)) for p in rows_of(a, u) for q in rows_of(b, v))
        assert n_lists <= 24 or most < 256  # some 24,000 pairs


def test_boxes_in_blocks_equal_the_columns(table):
    """F4, F7, F8: boxes, flat ones and points are related in blocks as in the JVM; null, repeated and NaN coordinates too."""
    draw, nan = random.Random(8), float("nan")
    spot = lambda: draw.choice([None, nan, *range(8), *range(8)])
    made = [(i // 2, float(x), float(x) + draw.choice([0, 1, 5]), y, y and y + draw.choice([0.0, 2.0])) for i in range(90) for x, y in [(draw.randrange(8), draw.choice([None, *map(float, range(8))]))]]
    a = table("id long, minx double, maxx double, miny double, maxy double", *made, (7, nan, nan, 1.0, 2.0), (None, 1.0, 2.0, 1.0, 2.0), *made[:5]).checkpoint()
    points = table("id long, x double, y double", *[(i // 2, *(None if v is None else float(v) for v in (spot(), spot()))) for i in range(80)]).checkpoint()
    for left, names in ((a, [n for n in relate.PREDICATES if n != "disjoint"]), (points, ["intersects", "within", "touches"])):
        kinds = spatial.kind_of(left), "box"
        plain = spatial.candidate_pairs(left, a).filter(spatial.exact_test("intersects", *kinds)).select(
            "l_id", "r_id", *[spatial.exact_test(n, *kinds).alias(n) for n in names])
        for hot_rows in (20_000, 6):
            got = spatial.spatial_join(left, a, keep=["l_id", "r_id"], also=names, hot_rows=hot_rows)
            assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, rows(got))) == sorted(map(str, rows(plain))) and got.count() > 100


def test_boxes_go_only_where_they_meet_others(table):
    """a row is sent to cells of its own size only if the other side has rows of it or finer ones, and no cell is quartered below its boxes."""
    cols = "id long, minx double, maxx double, miny double, maxy double"
    level = table(cols, *[(i, i / 4 - 0.125, i / 4 + 0.125, 0.0, 0.0) for i in range(100)])
    upright = table(cols, *[(i, i / 4, i / 4, -0.5, 0.5) for i in range(100)])
    placed = blocks._placed(level, upright, ["l_id", "r_id"], 0.0, 0.25, 20_000)
    assert placed.filter("_side = 0").select("_level").distinct().count() == 1 and placed.count() < 4 * 200
    assert not {"_l_lox", "_r_hix"} & set(placed.columns)
