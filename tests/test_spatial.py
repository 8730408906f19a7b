import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.functions import scalar as s
from geoloom.operators import classes, collections as co, linear, nearest, ordering, relate, simplify, spatial, tracks
from geoloom.operators.skew import salted_join


def wkt(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, wkt string")
    return df.select("id", g.from_wkt("wkt").alias("geom"))


TEXTS = ["POINT (1 2)", "LINESTRING (0 0, 3 4, 3 10)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))",
         "MULTIPOINT ((0 0), (2 2))", "MULTILINESTRING ((0 0, 1 0), (5 5, 5 7))",
         "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 9 5, 9 9, 5 9, 5 5), (6 6, 6 7, 7 7, 7 6, 6 6)))", "POLYGON EMPTY"]


def test_wkt_and_measures(spark):
    df = wkt(spark, *TEXTS)
    out = df.select(g.to_wkt(F.col("geom")), g.area(F.col("geom")), g.geom_length(F.col("geom")), g.num_points(F.col("geom")))
    got = rows(out, "id")
    assert [r[0] for r in got] == TEXTS
    assert [r[1] for r in got] == [0, 0, 15, 0, 0, 16, 0]
    assert [r[2] for r in got] == [0, 11, 20, 0, 3, 24, 0]
    assert [r[3] for r in got] == [1, 3, 10, 2, 4, 15, 0]
    c = df.select(g.centroid(F.col("geom")).alias("c")).select(g.get_x(F.col("c")), g.get_y(F.col("c")))
    c = rows(c)
    assert c[0] == (1, 2) and c[3] == (1, 1) and c[6] == (None, None)
    assert c[2] == pytest.approx(((16 * 2 - 1.5) / 15, (16 * 2 - 1.5) / 15))
    odd = wkt(spark, "point(1 2)", "CIRCLE (1 2)").select(g.to_wkt(F.col("geom")))
    assert rows(odd) == [("POINT (1 2)",), (None,)]


SHAPES = ["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((4 1, 6 1, 6 2, 4 2, 4 1))", "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))",
          "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))", "LINESTRING (-1 3, 5 3)", "LINESTRING (1 1, 3 3)", "POINT (0 2)", "POINT (2 2)", "POINT (9 9)"]
# Against the first square: what each shape is to it.
EXPECTED = ["contains equals intersects within", "intersects touches", "contains intersects", "intersects overlaps", "crosses intersects",
            "contains intersects", "intersects touches", "contains intersects", "disjoint"]


def plain_place(p, segs):
    """1 inside, 0 on the boundary, -1 outside an area of whole-number segments, by exact integers."""
    odd = False
    for (x1, y1), (x2, y2) in segs:
        side = (x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1)
        if side == 0 and min(x1, x2) <= p[0] <= max(x1, x2) and min(y1, y2) <= p[1] <= max(y1, y2):
            return 0
        if (y1 > p[1]) != (y2 > p[1]):
            odd ^= (side > 0) == (y2 > y1)
    return 1 if odd else -1


def ring_shape(n, cx, radius, wobble=0.0, seed=0):
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
    reach = radius * (1 + wobble * np.random.default_rng(seed).standard_normal(n))
    x, y = cx + reach * np.cos(angle), reach * np.sin(angle)
    return 2, np.append(x, x[0]), np.append(y, y[0]), np.array([n + 1])


def named(bits):
    return {n for i, n in enumerate(relate.PREDICATES) if bits >> i & 1}


def test_points_in_areas_equal_exact_integers():
    draw = random.Random(8)
    for _ in range(60):
        x, y, w, h = draw.randrange(5), draw.randrange(5), draw.randrange(3, 7), draw.randrange(3, 7)
        rings = [[(x, y), (x + w, y), (x + w + 1, y + h), (x, y + h), (x, y)], [(x + 1, y + 1), (x + 2, y + 1), (x + 1, y + 2), (x + 1, y + 1)]]
        area = (2, *(np.array([p[k] for r in rings for p in r], float) for k in (0, 1)), np.array([5, 4]))
        points = [(draw.randrange(13), draw.randrange(13)) for _ in range(40)]
        got = relate.each_pair(relate._relate, [((0, np.array([px], float), np.array([py], float), np.array([1])), area) for px, py in points])
        for p, bits in zip(points, got):
            place = plain_place(p, [s for r in rings for s in zip(r, r[1:])])
            assert named(bits) == {1: {"intersects", "within"}, 0: {"intersects", "touches"}, -1: {"disjoint"}}[place], (p, rings)


@pytest.mark.parametrize("n", [5, 40, 700])
def test_rings_by_their_middles(n):
    """Few vertices go through plain tables, many through cells: both know circles by their middles."""
    cases = [(0.0, 0.5, {"intersects", "contains"}), (1.0, 1.0, {"intersects", "overlaps"}), (3.0, 1.0, {"disjoint"}), (0.0, 1.0, {"intersects", "contains", "within", "equals"})]
    pairs = [(ring_shape(n, 0, 1), ring_shape(n, x, r)) for x, r, _ in cases]
    assert [named(b) for b in relate.each_pair(relate._relate, pairs)] == [want for *_, want in cases]
    gaps = relate.each_pair(relate._separation, pairs + [p[::-1] for p in pairs])
    far = min(math.dist(p, q) for p in zip(*pairs[2][0][1:3]) for q in zip(*pairs[2][1][1:3]))
    assert gaps[:2] == [0, 0] and gaps[2] == gaps[6] <= far + 1e-9 and gaps[2] >= 0.9


def test_large_rings_in_time_and_memory():
    import resource
    import time
    began = time.process_time()
    pairs = [(ring_shape(100_000, 0, 1, 1e-4, 1), ring_shape(100_000, 0.5, 1, 1e-4, 2)), (ring_shape(100_000, 0, 1), ring_shape(100_000, 3, 1))]
    assert relate.each_pair(relate._separation, pairs) == [0.0, pytest.approx(1.0)]
    assert time.process_time() - began < 20
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1 << 20


def test_box_pairs_equal_brute_force():
    draw = np.random.default_rng(3)
    for scale in (1e-6, 1.0, 50.0):
        corner = np.concatenate((draw.random((400, 2)), draw.random((400, 2)) * 1e-3))
        size = draw.random((800, 2)) * scale * draw.choice([0, 1e-3, 1], (800, 1))
        a = np.concatenate((corner, corner + size), axis=1)
        b = a[::-3] + 1e-4
        got = sorted(p for i, j in relate.box_pairs(a, b) for p in zip(i.tolist(), j.tolist()))
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if (a[i, :2] <= b[j, 2:]).all() and (b[j, :2] <= a[i, 2:]).all()]
        assert got == want


def test_relations(spark):
    df = wkt(spark, *SHAPES)
    square = df.filter("id = 0").select(F.col("geom").alias("a"))
    pairs = df.join(square)
    bits = pairs.select("id", relate.relation(F.col("a"), F.col("geom")).alias("b"),
                        relate.relation(F.col("geom"), F.col("a")).alias("r")).orderBy("id").collect()
    for row, want in zip(bits, EXPECTED):
        held = " ".join(sorted(n for i, n in enumerate(relate.PREDICATES) if row.b >> i & 1))
        assert held == want, SHAPES[row.id]
        swap = {"contains": "within", "within": "contains"}
        back = sorted(swap.get(n, n) for i, n in enumerate(relate.PREDICATES) if row.r >> i & 1)
        assert back == want.split()


def random_boxes(n, big):
    out = []
    for i in range(n):
        w, h = (random.choice([0.1, 1, 5, big]) * random.random() for _ in "xy")
        x, y = random.uniform(-50, 50), random.uniform(-50, 50)
        out.append((i, round(x, 3), round(x + w, 3), round(y, 3), round(y + h, 3)))
    return out


@pytest.mark.parametrize("cell", [0.25, 10.0])
def test_box_join_equals_brute_force(table, cell):
    random.seed(3)
    a, b = random_boxes(120, 80), random_boxes(150, 300)
    b.append((900, *a[0][1:]))  # identical features
    cols = "id long, minx double, maxx double, miny double, maxy double"
    pairs = spatial.spatial_join(table(cols, *a), table(cols, *b), cell=cell, hot_rows=20).select("l_id", "r_id")
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[2] and p[2] >= q[1] and p[3] <= q[4] and p[4] >= q[3])
    assert rows(pairs, "l_id", "r_id") == want


def test_crowds_give_pairs_in_proportion(spark):
    """A hundred thousand points and ten thousand boxes inside a quarter degree, half of the points on one spot."""
    points = spark.range(100_000).selectExpr("id", "if(id % 2 = 0, 0.2D + id * 1e-9D, rand(1) * 0.25D) as x", "if(id % 2 = 0, 0.2D, rand(2) * 0.25D) as y").checkpoint()
    boxes = spark.range(10_000).selectExpr("id", "rand(3) * 0.19D as minx", "rand(4) * 0.19D as miny", "0.0005D + (id % 4) * 0.0005D as side").selectExpr(
        "id", "minx", "minx + side as maxx", "miny", "miny + side as maxy").checkpoint()
    met = spatial.candidate_pairs(points, boxes).count()
    b = np.array(boxes.select("minx", "maxx", "miny", "maxy").collect())
    p = np.array(points.select("x", "y").collect())
    want = sum(int(((p[:, 0] >= x1) & (p[:, 0] <= x2) & (p[:, 1] >= y1) & (p[:, 1] <= y2)).sum()) for x1, x2, y1, y2 in b)
    assert met == want
    assert spatial.cell_pairs(points, boxes).count() < 100 * want


@pytest.mark.parametrize("crowded", [1, 50])
def test_quartered_cells_equal_brute_force(table, monkeypatch, crowded):
    monkeypatch.setattr(spatial, "CROWDED", crowded)
    draw = random.Random(crowded)
    cols = "id long, minx double, maxx double, miny double, maxy double"
    make = lambda n: [(i, x := draw.choice([0.5, draw.random()]), x + draw.choice([0, 1e-7, 0.01, 0.3, 2]), y := draw.choice([-0.25, draw.random()]), y + draw.choice([0, 0.02, 0.5])) for i in range(n)]
    a, b = make(70), make(80)
    got = rows(spatial.candidate_pairs(table(cols, *a), table(cols, *b)).select("l_id", "r_id"), "l_id", "r_id")
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4])
    spots = table("id long, x double, y double", *[(i, p[1], p[3]) for i, p in enumerate(a)])
    same = rows(spatial.spatial_join(spots, spots).select("l_id", "r_id"), "l_id", "r_id")
    assert same == sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(a) if (p[1], p[3]) == (q[1], q[3]))


def test_points_at_cell_borders(table):
    pts = table("id long, x double, y double", (1, 0.0, 0.0), (2, 0.25, 0.25), (3, -0.25, 0.5), (4, 1.0, 1.0))
    box = table("id long, minx double, maxx double, miny double, maxy double", (1, 0.0, 0.25, 0.0, 0.25))
    assert rows(spatial.spatial_join(pts, box).select("l_id"), "l_id") == [(1,), (2,)]
    assert rows(spatial.spatial_join(pts, box, "touches").select("l_id"), "l_id") == [(1,), (2,)]
    assert rows(spatial.spatial_semi(pts, box, "disjoint").select("id"), "id") == [(3,), (4,)]
    near = spatial.distance_join(pts, box, 0.5).select("l_id", "distance")
    assert rows(near, "l_id") == [(1, 0.0), (2, 0.0), (3, pytest.approx(math.hypot(0.25, 0.25)))]
    assert rows(spatial.beyond(pts, box, 0.5).select("id")) == [(4,)]


def test_geometry_distances_equal_pairwise_kernel(spark):
    df = wkt(spark, *SHAPES)
    out = spatial.distance_join(df, df, 3.0).select("l_id", "r_id", "distance")
    got = {(r.l_id, r.r_id): r.distance for r in out.collect()}
    every = df.select(F.col("id").alias("i"), F.col("geom").alias("a")).join(df.select(F.col("id").alias("j"), F.col("geom").alias("b")))
    want = {(r.i, r.j): r.d for r in every.select("i", "j", relate.distance(F.col("a"), F.col("b")).alias("d")).collect() if r.d <= 3}
    assert got == pytest.approx(want)
    spots = df.filter(g.dimension(F.col("geom")) == 0).select("id", g.get_x(F.col("geom")).alias("x"), g.get_y(F.col("geom")).alias("y"))
    jvm = {(r.l_id, r.r_id): r.distance for r in spatial.distance_join(spots, df, 3.0).collect()}
    assert jvm == pytest.approx({k: v for k, v in want.items() if k[0] >= 6})


def test_hot_keys_are_spread_and_whole(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"))
    right = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = salted_join(left, right, ["k"], "id", hot_rows=50)
    want = left.join(right, "k")
    assert out.select("id", "k", "v").exceptAll(want.select("id", "k", "v")).count() == 0 and out.count() == 3000


@pytest.mark.parametrize("levels", [None, 2, 9])
def test_nearest_equals_brute_force(table, levels):
    random.seed(11)
    items = [(i, random.choice([0, 0, 50]) + random.gauss(0, random.choice([0.01, 5])), random.gauss(0, 20)) for i in range(300)]
    items += [(i + 1000, *items[i][1:]) for i in range(5)]  # ties
    asks = [(i, random.uniform(-200, 200), random.uniform(-100, 100)) for i in range(150)]
    cols = "id long, x double, y double"
    out = nearest.nearest_join(table(cols, *asks), table(cols, *items), levels)
    got = {r.id: (r.nearest_id, r.distance) for r in out.collect()}
    for i, x, y in asks:
        d, n = min((math.hypot(px - x, py - y), k) for k, px, py in items)
        assert got[i] == (n, pytest.approx(d))


def test_nearest_and_snap_to_lines(spark, table):
    lines = wkt(spark, "LINESTRING (0 0, 10 0)", "LINESTRING (0 5, 10 5, 10 9)", "LINESTRING (-100 -100, -99 -100)")
    asks = table("id long, x double, y double", (1, 4.0, 1.0), (2, 11.0, 8.0), (3, -120.0, -100.0), (4, 4.0, 2.5))
    out = nearest.snap(asks, lines)
    assert rows(out, "id") == [(1, 0, 4, 0, 1), (2, 1, 10, 8, 1), (3, 2, -100, -100, 20), (4, 0, 4, 0, 2.5)]
    one = nearest.nearest(lines, 11.0, 8.0)
    assert rows(one) == [(1, 1.0)]


def test_simplify_properties():
    rng = np.random.default_rng(1)
    for tol in (0, 0.1, 1.0):
        x, y = np.cumsum(rng.normal(size=200)), np.cumsum(rng.normal(size=200))
        keep = simplify.keep_mask(x, y, tol)
        assert keep[0] and keep[-1]
        kept = np.flatnonzero(keep)
        for i, j in zip(kept, kept[1:]):  # every dropped vertex is close to the line that replaces it
            shape = relate._Shape(1, [x[i], x[j]], [y[i], y[j]], [2])
            assert relate._gap(np.column_stack([x[i:j + 1], y[i:j + 1]]), shape).max() <= tol + 1e-12
    assert simplify.keep_mask(np.array([0., 1, 2, 3]), np.zeros(4), 0).tolist() == [True, False, False, True]


def test_simplify_geometries(spark):
    texts = ["POINT (1 2)", "LINESTRING (0 0, 1 0.05, 2 0, 3 5)", "POLYGON ((0 0, 2 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1.01 1, 1.01 1.01, 1 1))",
             "MULTIPOLYGON (((0 0, 0.01 0, 0.01 0.01, 0 0)), ((5 5, 9 5, 9 9, 5 9, 5 5)))", "LINESTRING (0 0, 9 9)"]
    out = simplify.simplify_features(wkt(spark, *texts), 0.1).select(g.to_wkt(F.col("geom")))
    assert [r[0] for r in rows(out, "id")] == ["POINT (1 2)", "LINESTRING (0 0, 2 0, 3 5)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))",
                                               "MULTIPOLYGON (((5 5, 9 5, 9 9, 5 9, 5 5)))", "LINESTRING (0 0, 9 9)"]


def test_quantiles_of_hot_and_tied_groups(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
                                  F.when(F.col("id") % 5 == 0, 7.0).otherwise((F.col("id") * 7919 % 1000) / 3.0).alias("v"))
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    for bins in (1, 7, 64):
        got = {(r.k, r.prob): r.quantile for r in ordering.exact_quantiles(df, "v", probs, ["k"], bins).collect()}
        want = df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()
        assert got == pytest.approx({(r.k, p): q for r in want for p, q in zip(probs, r.q)})


def test_jenks_equals_exhaustive_search():
    random.seed(2)
    values = sorted(random.choice([1, 2, 10, 11, 30]) + random.random() for _ in range(14))
    bars = pd.DataFrame({"n": 1.0, "s": values, "q": [v * v for v in values], "low": values, "high": values})
    got = classes.natural_breaks(bars, 3)

    def cost(groups):
        return sum(sum((v - sum(gr) / len(gr)) ** 2 for v in gr) for gr in groups)

    best = min((cost([values[:i], values[i:j], values[j:]]), i, j) for i in range(1, 13) for j in range(i + 1, 14))
    assert got == [values[0], values[best[1] - 1], values[best[2] - 1], values[-1]]


def test_jenks_over_many_values(spark):
    noise = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1e6
    df = spark.range(5000).select(F.when(F.col("id") < 2500, noise).otherwise(noise + 10).alias("v"))
    breaks = classes.jenks(df, "v", 2).first().breaks
    assert len(breaks) == 3 and 0.9 < breaks[1] <= 1.1


def test_hull_of_spread_points(spark):
    df = spark.range(2000).select(F.lit("a").alias("locator"), (F.rand(1) * 10).alias("x"), (F.rand(2) * 10).alias("y"))
    df = df.unionByName(spark.createDataFrame([("a", x, y) for x in (-1.0, 11.0) for y in (-1.0, 11.0)] + [("p", 1.0, 1.0)] * 2
                                              + [("l", 0.0, 0.0), ("l", 1.0, 1.0), ("l", 2.0, 2.0)], "locator string, x double, y double"))
    out = co.convex_hull(df).select("locator", g.to_wkt(F.col("geom")))
    assert rows(out, "locator") == [("a", "POLYGON ((-1 -1, 11 -1, 11 11, -1 11, -1 -1))"), ("l", "LINESTRING (0 0, 2 2)"), ("p", "POINT (1 1)")]


def test_hull_merged_over_shares_equals_one_pass(spark, monkeypatch):
    monkeypatch.setattr(co, "HULL_SHARE", 7)  # hundreds of shares, merged in two steps
    turn = F.col("id") * 0.01
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(1)).alias("k"), (F.cos(turn) * 50).alias("x"), (F.sin(turn * 3) * 20).alias("y"))
    df = df.unionByName(spark.createDataFrame([(2, None, 1.0), (3, 4.0, 5.0)], "k int, x double, y double"))
    found = {r.k: r.n for r in co.convex_hull(df, "k").select("k", g.num_points(F.col("geom")).alias("n")).collect()}
    spots = df.na.drop(subset=["x", "y"]).toPandas()
    want = {k: len(co._hull(f.x.to_numpy(), f.y.to_numpy())) for k, f in ((None, spots[spots.k.isna()]), (1, spots[spots.k == 1]))}
    assert found == {3: 1, **{k: n + 1 for k, n in want.items()}}


def test_collect_in_parts(spark):
    df = spark.range(1000).select("id", F.lit("a").alias("k"), g.point(F.col("id"), F.lit(0.0)).alias("geom"))
    out = co.collect_geometries(df, ["k"], members=100)
    assert out.agg(F.sum(g.num_geometries(F.col("geom")))).first()[0] == 1000
    assert out.count() == out.first().parts == 10


def test_track_cut_anywhere(spark):
    df = spark.range(500).select(F.lit("t").alias("k"), (F.lit("2020-01-01").cast("timestamp") + F.make_interval(secs=F.col("id") % 250)).alias("ts"),
                                 "id", (F.col("id") * 37 % 100).cast("double").alias("x"), (F.col("id") * 53 % 90).cast("double").alias("y"))
    pts = [(r.x, r.y) for r in df.orderBy("ts", "id").collect()]
    want = sum(math.dist(p, q) for p, q in zip(pts, pts[1:]))
    for bins in (1, 5, 64):
        assert rows(tracks.track_lengths(df, ["k"], ["ts", "id"], bins)) == [("t", 500, pytest.approx(want))]


def test_linear_reference(spark):
    line = wkt(spark, "LINESTRING (0 0, 10 0, 10 10)").withColumns({"from_measure": F.lit(100.0), "to_measure": F.lit(120.0)})
    assert rows(linear.geocode(line, F.lit(115.0))) == [(0, 115.0, 10.0, 5.0)]
    assert rows(linear.geocode(line, F.lit(110.0))) == [(0, 110.0, 10.0, 0.0)]
    assert linear.geocode(line, F.lit(99.0)).count() == 0
    assert rows(linear.measure_at(line, F.lit(12.0), F.lit(4.0))) == [(0, 114.0, 2.0)]
    piece = linear.segment_between(line, F.lit(105.0), F.lit(112.0)).select(g.to_wkt(F.col("geom")))
    assert rows(piece) == [("LINESTRING (5 0, 10 0, 10 2)",)]


def test_scalar_edges(table):
    df = table("x double, t string", (-2.5, "a-b-a"), (2.5, "xx"), (None, None))
    out = df.select(s.round_half_up(F.col("x")), s.maximum(F.col("x"), 0.0), s.last_index_of(F.col("t"), "a"),
                    s.replace(F.col("t"), "(a)", "<$1>", False), s.substring(F.col("t"), 2, 3), s.trim2(F.col("t"), "trailing", "a"),
                    s.recode(F.col("x"), 2.5, "hit"), s.interpolate(F.col("x"), 0, 0, 5, 10), s.position("b", F.col("t")))
    assert [tuple(r) for r in out.collect()] == [
        (-2, 0.0, 4, "<a>-b-a", "b", "a-b-", None, 0.0, 3), (3, 2.5, -1, "xx", "", "xx", "hit", 5.0, 0),
        (None,) * 9]


def test_edits(table):
    base = table("id long, v string", (1, "a"), (2, "b"), (3, "c"))
    out = co.apply_changes(base, table("id long, v string", (9, "n")), table("id long, v string", (2, "B"), (7, "x")), table("id long", (3,)))
    assert rows(out, "id") == [(1, "a"), (2, "B"), (9, "n")]
    page = co.query_features(base, F.col("v") > "a", ["v"], [F.desc("id")], 1)
    assert rows(page) == [("c",)]


def test_published_names_are_there():
    from geoloom.functions.registry import FUNCTIONS, TABLE_FUNCTIONS
    assert len(set(FUNCTIONS) | set(TABLE_FUNCTIONS)) == 178
