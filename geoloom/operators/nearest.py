"""Exact nearest neighbours by descending a pyramid of grid cells.

Every query starts in the few cells of the top level. Going down one level, a cell is kept if it
may hold something nearer than the farthest corner of a cell known to hold something. Few cells
per query remain at each level, whatever the distances, and each step is an equi-join on cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.operators.blocks import nearest_in_blocks
from geoloom.operators.skew import computed_once, salted_join
from geoloom.operators.spatial import kind_of, with_box
from geoloom.session import checkpointed

FANOUT = 4
# Levels with no more cells than this in all are joined by broadcast.
SMALL_LEVEL = 70_000


def nearest(features: DataFrame, x: float, y: float) -> DataFrame:
    """The feature nearest to one position; ties go to the smallest id."""
    gap = _box_gap(F.lit(float(x)), F.lit(float(y))) if kind_of(features) != "geometry" else g.point_to_geometry(
        F.lit(float(x)), F.lit(float(y)), F.col("geom"))
    near = with_box(features).withColumn("distance", gap)
    return near.agg(F.min_by(F.struct("id", "distance"), F.struct("distance", "id")).alias("n")).select("n.*")


def _box_gap(x: Column, y: Column, prefix: str = "") -> Column:
    """Distance from a position to a box."""
    dx = F.greatest(F.lit(0.0), F.col(f"{prefix}minx") - x, x - F.col(f"{prefix}maxx"))
    dy = F.greatest(F.lit(0.0), F.col(f"{prefix}miny") - y, y - F.col(f"{prefix}maxy"))
    return F.hypot(dx, dy)


class _Pyramid:
    """Square cells over the extent of the items; level 0 is the finest."""

    def __init__(self, items: DataFrame, levels: int | None):
        # One row: the extent and the number of items fix the cell sizes.
        row = items.agg(F.min("minx"), F.max("maxx"), F.min("miny"), F.max("maxy"), F.count(F.lit(1))).first()
        self.origin = {"x": row[0] or 0.0, "y": row[2] or 0.0}
        extent = max((row[1] or 0.0) - self.origin["x"], (row[3] or 0.0) - self.origin["y"], 1e-9)
        # About one item per cell at the finest level, and two levels more for clusters.
        self.levels = levels or min(14, max(2, math.ceil(math.log(max(row[4], 1), FANOUT ** 2)) + 3))
        self.sizes = [extent / FANOUT ** (self.levels - 1 - i) for i in range(self.levels)]

    def cell(self, axis: str, value: Column, level: Column) -> Column:
        """Cell numbers come from the finest level, so that levels nest exactly."""
        fine = F.floor((value - self.origin[axis]) / self.sizes[0]).cast("bigint")
        return F.floor(fine / F.pow(F.lit(FANOUT), level)).cast("bigint")

    def small(self, level: int) -> bool:
        return (FANOUT ** (self.levels - 1 - level) + 1) ** 2 <= SMALL_LEVEL

    def reach(self) -> tuple[Column, Column]:
        """(nearest, farthest) distance from (qx, qy) to the cell in (level, cx, cy)."""
        size = F.array(*[F.lit(s) for s in self.sizes])[F.col("level")]
        near, far = [], []
        for a in "xy":
            low, q = F.lit(self.origin[a]) + F.col(f"c{a}") * size, F.col(f"q{a}")
            near.append(F.greatest(F.lit(0.0), low - q, q - low - size))
            far.append(F.greatest(F.abs(q - low), F.abs(q - low - size)))
        slack = size * 1e-9  # cell sides are rounded; stay on the safe side
        return F.hypot(*near) - slack, F.hypot(*far) + slack


def _occupied(grid: _Pyramid, sitting: DataFrame, anchors: DataFrame) -> DataFrame:
    """Cells in use at every level: (level, cx, cy), `anchored` where an item surely touches the
    cell, `sits` where items of just this level are kept."""
    cells = sitting.select("level", "cx", "cy", F.lit(False).alias("anchored")).unionByName(anchors)
    up = F.explode(F.sequence(F.col("level"), F.lit(grid.levels - 1)))
    spread = cells.select("cx", "cy", "anchored", F.col("level").alias("own"), up.alias("level"))
    step = F.pow(F.lit(FANOUT), F.col("level") - F.col("own"))
    return spread.groupBy(
        "level", F.floor(F.col("cx") / step).cast("bigint").alias("cx"),
        F.floor(F.col("cy") / step).cast("bigint").alias("cy")).agg(
            F.bool_or("anchored").alias("anchored"),
            F.bool_or((F.col("level") == F.col("own")) & ~F.col("anchored")).alias("sits"))


def _next_cells(occupied: DataFrame, level: int, nested: bool) -> DataFrame:
    """Where each cell of `level` leads: its children, and itself as a leaf where items sit in it.
    Leaves reached earlier lead to themselves."""
    goal = [F.col("level"), F.col("cx"), F.col("cy"), F.col("anchored")]
    children = occupied.filter(F.col("level") == level - 1).select(
        F.lit(level).alias("_level"), F.floor(F.col("cx") / FANOUT).cast("bigint").alias("_x"),
        F.floor(F.col("cy") / FANOUT).cast("bigint").alias("_y"), F.lit(False).alias("_leaf"),
        *goal, F.lit(False).alias("leaf"))
    if not nested:
        return children
    leaves = occupied.filter((F.col("level") >= level) & F.col("sits"))
    return children.unionByName(leaves.select(
        F.col("level").alias("_level"), F.col("cx").alias("_x"), F.col("cy").alias("_y"),
        (F.col("level") > level).alias("_leaf"), *goal, F.lit(True).alias("leaf")))


def nearest_join(queries: DataFrame, items: DataFrame, levels: int | None = None) -> DataFrame:
    """For each query point (id, x, y) the nearest item: `id`, `nearest_id`, `distance`.

    Items are points, boxes or geometries; ties go to the smallest id. The pyramid of occupied
    cells is written once to the shared checkpoint folder.
    """
    kind = kind_of(items)
    boxed = with_box(items)
    if kind == "point":  # equal positions differ in id only
        boxed = boxed.groupBy("x", "y").agg(F.min("id").alias("id")).select(
            "id", "x", "y", *[F.col(c).alias(m + c) for c in "xy" for m in ("min", "max")])
    boxed = boxed.filter(F.col("minx").isNotNull())
    grid = _Pyramid(boxed, levels)
    top = grid.levels - 1

    # Each item sits at the level whose cells it fits, and has one position it surely touches.
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    own = sum(((extent > grid.sizes[i]).cast("int") for i in range(top)), F.lit(0))
    sitting = computed_once(boxed, level=own)
    for a in "xy":
        sitting = sitting.withColumn(f"c{a}", F.explode(F.sequence(
            grid.cell(a, F.col(f"min{a}"), F.col("level")), grid.cell(a, F.col(f"max{a}"), F.col("level")))))
    at = {a: (g.get_x if a == "x" else g.get_y)(F.col("geom")) if kind == "geometry" else F.col(f"min{a}") for a in "xy"}
    anchors = boxed.select(F.lit(0).alias("level"), *[grid.cell(a, at[a], F.lit(0)).alias(f"c{a}") for a in "xy"],
                           F.lit(True).alias("anchored"))
    occupied = checkpointed(_occupied(grid, sitting, anchors))

    # The top level has at most four cells.
    roots = occupied.filter(F.col("level") == top).agg(F.collect_list(F.struct(
        "level", "cx", "cy", "anchored", F.lit(False).alias("leaf")))).scalar()
    front = queries.select(F.col("id").alias("qid"), F.col("x").cast("double").alias("qx"),
                           F.col("y").cast("double").alias("qy"), F.lit(math.inf).alias("bound"),
                           F.explode(roots).alias("c")).select("qid", "qx", "qy", "bound", "c.*")
    near, far = grid.reach()
    per_query = Window.partitionBy("qid")
    for level in range(top, -1, -1):
        best = F.min(F.when(F.col("anchored"), F.col("_far"))).over(per_query)
        front = (front.withColumns({"_near": near, "_far": far})
                 .withColumn("bound", F.least("bound", best)).filter(F.col("_near") <= F.col("bound"))
                 .select("qid", "qx", "qy", "bound", F.col("level").alias("_level"), F.col("cx").alias("_x"),
                         F.col("cy").alias("_y"), F.col("leaf").alias("_leaf")))
        if level:
            follow = _next_cells(occupied, level, kind != "point")
            # A level of few cells has a bounded table; larger ones are left to the planner, which
            # splits hot cells as it runs.
            follow = F.broadcast(follow) if grid.small(level - 1) else follow
            front = front.join(follow, ["_level", "_x", "_y", "_leaf"]).select(
                "qid", "qx", "qy", "bound", "level", "cx", "cy", "anchored", "leaf")
    front = front.select("qid", "qx", "qy", "bound", F.col("_level").alias("level"),
                         F.col("_x").alias("cx"), F.col("_y").alias("cy"))
    if kind == "geometry":
        # Pairs are many where items overlap: they meet block by block, and few of a query's are left to compare.
        near = checkpointed(front).select("level", "cx", "cy", "bound", F.col("qid").alias("id"), F.col("qx").alias("x"), F.col("qy").alias("y"))
        found = nearest_in_blocks(near, sitting)
        gap = g.point_to_geometry(F.col("qx"), F.col("qy"), F.col("geom"))
    else:
        gap = _box_gap(F.col("qx"), F.col("qy"))
        found = salted_join(front, sitting, ["level", "cx", "cy"], "qid").filter(gap <= F.col("bound"))
    scored = found.withColumn("distance", gap)
    best = scored.groupBy("qid").agg(F.min_by(F.struct("id", "distance"), F.struct("distance", "id")).alias("n"))
    return best.select(F.col("qid").alias("id"), F.col("n.id").alias("nearest_id"), F.col("n.distance").alias("distance"))


def snap(queries: DataFrame, lines: DataFrame, levels: int | None = None) -> DataFrame:
    """Each query point moved to the nearest place on the nearest line: id, nearest_id, x, y, distance."""
    pairs = nearest_join(queries, lines, levels)
    segs = lines.select(F.col("id").alias("nearest_id"), F.explode(F.flatten(F.transform(
        F.flatten(F.col("geom")["parts"]), g.segments))).alias("s"))
    at = pairs.join(queries.select("id", "x", "y"), "id").join(segs, "nearest_id")
    dx, dy = F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y")
    along = ((F.col("x") - F.col("s.a.x")) * dx + (F.col("y") - F.col("s.a.y")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.least(F.greatest(F.coalesce(along, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    put = at.withColumn("_t", t).select(
        "id", "nearest_id", "distance", (F.col("s.a.x") + F.col("_t") * dx).alias("px"),
        (F.col("s.a.y") + F.col("_t") * dy).alias("py"), "x", "y")
    gap = F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
    return put.groupBy("id", "nearest_id", "distance").agg(
        F.min_by(F.struct("px", "py"), F.struct(gap, "px", "py")).alias("p")).select(
            "id", "nearest_id", F.col("p.px").alias("x"), F.col("p.py").alias("y"), "distance")
