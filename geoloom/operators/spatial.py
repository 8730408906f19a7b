"""Spatial filters and joins.

A table takes part as points (`x`, `y`), boxes (`minx`, `maxx`, `miny`, `maxy`) or geometries
(`geom`). Joins go through grid cells: an ordinary equi-join on the cell, then the box test, then
the exact test; with geometries, between boxes and of points in boxes both tests go block by block (`blocks`). Cells come in sizes that grow by four, without a finest or a coarsest one; an item uses the size it fits, so it
covers four cells at most, and a pair meets at the coarser of its two sizes, in one cell only. A cell that
holds very many rows of both sides is quartered as often as their numbers ask for.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from geoloom.functions import geometry as g
from geoloom.operators import blocks
from geoloom.operators.blocks import each_pair  # noqa: F401
from geoloom.operators.relate import PREDICATES, holds
from geoloom.operators.skew import computed_once
from geoloom.session import checkpointed

CELL = 0.25  # the size that others are multiples of, by powers of four
FINEST = -16  # powers below this one are finer than double precision tells apart
CROWDED = 1_000_000  # pairs of rows that a cell may give before it is quartered
MOST_QUARTERED = 8
BOX = ["minx", "maxx", "miny", "maxy"]


def kind_of(df: DataFrame) -> str:
    if "geom" in df.columns:
        return "geometry"
    return "point" if {"x", "y"} <= set(df.columns) else "box"


def with_box(df: DataFrame) -> DataFrame:
    """Adds the four box columns a table lacks."""
    if set(BOX) <= set(df.columns):
        return df
    if kind_of(df) == "point":
        return df.withColumns({"minx": F.col("x"), "maxx": F.col("x"), "miny": F.col("y"), "maxy": F.col("y")})
    boxed = computed_once(df, _e=g.envelope(F.col("geom")))
    return boxed.select(*df.columns, *[F.col("_e")[f].alias(b) for b, f in zip(BOX, ("minX", "maxX", "minY", "maxY"))])


def bbox_filter(df: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Rows whose box meets the given one. Stored box columns let the scan skip files."""
    return with_box(df).filter((F.col("minx") <= maxx) & (F.col("maxx") >= minx)
                               & (F.col("miny") <= maxy) & (F.col("maxy") >= miny)).select(*df.columns)


def _as_geometry(prefix: str, kind: str) -> Column:
    c = {name: F.col(prefix + name) for name in ("x", "y", "geom", *BOX)}
    if kind == "point":
        return g.point(c["x"], c["y"])
    return c["geom"] if kind == "geometry" else g.box(c["minx"], c["miny"], c["maxx"], c["maxy"])


def _place_point(x: Column, y: Column, geom: Column) -> Column:
    """1 inside, 0 on the boundary, -1 outside, for a geometry of any kind."""
    rings = F.flatten(geom["parts"])
    same = lambda v: (v["x"] == x) & (v["y"] == y)
    on = F.exists(rings, lambda r: F.exists(g.segments(r), lambda s: g._on_segment(x, y, s)))
    tips = F.aggregate(rings, F.lit(0), lambda acc, r: acc + same(r[0]).cast("int") + same(F.element_at(r, -1)).cast("int"))
    return (F.when(g.dimension(geom) == 2, g.locate_point(x, y, geom))
            .when(g.dimension(geom) == 1, F.when(~on, -1).when(tips % 2 == 1, 0).otherwise(1))
            .otherwise(F.when(F.exists(g.vertices(geom), same), 1).otherwise(-1)))


_BY_PLACE = {"intersects": lambda p: p >= 0, "within": lambda p: p == 1, "touches": lambda p: p == 0,
             "disjoint": lambda p: p < 0}


def _boxes(predicate: str, a: str, b: str) -> Column:
    """Predicates between boxes; one without area is a line or a point, whose inside lies on it."""
    A, B = ({n: F.col(p + n) for n in BOX} for p in (a, b))
    flat = lambda box, axis: box[f"min{axis}"] == box[f"max{axis}"]
    meet, inside, around, share, thick = F.lit(True), F.lit(True), F.lit(True), F.lit(True), F.lit(0)
    sizes = [F.lit(0), F.lit(0)]
    for x in "xy":
        (a1, a2), (b1, b2) = ((box[f"min{x}"], box[f"max{x}"]) for box in (A, B))
        low, high = F.greatest(a1, b1), F.least(a2, b2)
        meet, inside, around = meet & (low <= high), inside & (a1 >= b1) & (a2 <= b2), around & (a1 <= b1) & (a2 >= b2)
        inner = (F.when(flat(A, x) & flat(B, x), a1 == b1).when(flat(A, x), (a1 > b1) & (a1 < b2))
                 .when(flat(B, x), (b1 > a1) & (b1 < a2)).otherwise(low < high))
        share, thick = share & inner, thick + (low < high).cast("int")
        sizes = [n + (~flat(box, x)).cast("int") for n, box in zip(sizes, (A, B))]
    within, contains = inside & share, around & share
    apart = share & ~within & ~contains
    return {"intersects": meet, "disjoint": ~meet, "within": within, "contains": contains, "equals": inside & around,
            "touches": meet & ~share, "overlaps": apart & (sizes[0] == sizes[1]) & (thick == sizes[0]),
            "crosses": apart & ((sizes[0] != sizes[1]) | (thick < sizes[0]))}[predicate]


def exact_test(predicate: str, left_kind: str, right_kind: str) -> Column:
    """Condition on the `l_` and `r_` columns of a candidate pair."""
    if left_kind == "point" and right_kind != "point" and predicate in _BY_PLACE:
        x, y = F.col("l_x"), F.col("l_y")
        if right_kind == "box":
            inside = (x > F.col("r_minx")) & (x < F.col("r_maxx")) & (y > F.col("r_miny")) & (y < F.col("r_maxy"))
            meet = _boxes("intersects", "l_", "r_")
            return {"intersects": meet, "within": inside, "touches": meet & ~inside, "disjoint": ~meet}[predicate]
        return _BY_PLACE[predicate](_place_point(x, y, F.col("r_geom")))
    if left_kind == right_kind == "box":
        return _boxes(predicate, "l_", "r_")
    return holds(predicate, _as_geometry("l_", left_kind), _as_geometry("r_", right_kind))


def _levelled(df: DataFrame, prefix: str, cell: float, margin: float) -> DataFrame:
    """Columns renamed with a prefix, the box grown by `margin`, and the cell size that fits it."""
    boxed = with_box(df)
    out = boxed.select(*[F.col(c).alias(prefix + c) for c in boxed.columns])
    lo = {a: F.col(f"{prefix}min{a}") - margin if margin else F.col(f"{prefix}min{a}") for a in "xy"}
    hi = {a: F.col(f"{prefix}max{a}") + margin if margin else F.col(f"{prefix}max{a}") for a in "xy"}
    extent = F.greatest(hi["x"] - lo["x"], hi["y"] - lo["y"])
    level = F.when(extent > 0, F.greatest(F.ceil(F.log(extent / cell) / math.log(4)).cast("int"), F.lit(FINEST)))
    return computed_once(out.filter(F.col(f"{prefix}minx").isNotNull()), **{
        **{f"_{prefix}lo{a}": lo[a] for a in "xy"}, **{f"_{prefix}hi{a}": hi[a] for a in "xy"},
        f"_{prefix}level": level})


def _in_cells(df: DataFrame, prefix: str, other_levels: Column, cell: float, finest: Column | int = 0) -> DataFrame:
    """One row per covered cell, at the item's own size and the coarser sizes the other side uses; an item without extent is of the finest."""
    own = F.coalesce(F.col(f"_{prefix}level"), F.lit(finest))
    used = F.array_union(F.array(own), F.array_except(other_levels, F.sequence(F.lit(FINEST), own)))
    out = df.withColumn("_level", F.explode(used)).withColumn("_size", F.lit(float(cell)) * F.pow(F.lit(4.0), F.col("_level")))
    for a in "xy":
        first, last = (F.floor(F.col(f"_{prefix}{end}{a}") / F.col("_size")) for end in ("lo", "hi"))
        out = out.withColumn(f"_c{a}", F.explode(F.sequence(first, last)))
    return out


_CELL = ["_level", "_cx", "_cy"]


def _crowds(a: DataFrame, b: DataFrame, hot_rows: int) -> DataFrame:
    """Cells whose rows of both sides give more than CROWDED pairs, how often each is to be quartered, and into how many shares
    each side of a part is to be dealt: a row for a thousand rows at least."""
    rows = a.select(*_CELL, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(*_CELL, F.lit(0).alias("l"), F.lit(1).alias("r")))
    counted = rows.groupBy(*_CELL).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    pairs = F.col("l").cast("double") * F.col("r")
    # Points spread evenly leave a sixteenth of the pairs in each quarter.
    cuts = F.when(pairs > CROWDED, F.least(F.ceil(F.log(pairs / CROWDED) / math.log(16)) + 1, F.lit(MOST_QUARTERED))).otherwise(0)
    shares = lambda n: F.ceil(F.col(n) / F.pow(F.lit(4.0), F.col("_cuts")) / hot_rows).cast("int").alias(f"_{n}_shares")
    crowded = counted.filter((F.col("l") > 0) & (F.col("r") > 0) & ((pairs > CROWDED) | (F.col("l") > hot_rows) | (F.col("r") > hot_rows)))
    return crowded.withColumn("_cuts", cuts.cast("int")).select(*_CELL, "_cuts", shares("l"), shares("r"))


def _quartered(df: DataFrame, side: str, crowds: DataFrame) -> DataFrame:
    """One row per covered part of a crowded cell, dealt into shares; other cells are one part. What is still uneven Spark splits while it runs."""
    other = "r" if side == "l" else "l"
    out = df.join(crowds, _CELL, "left").withColumn("_parts", F.pow(F.lit(2.0), F.coalesce("_cuts", F.lit(0))))
    for a in "xy":
        first, last = (F.floor(F.col(f"_{side}_{end}{a}") / (F.col("_size") / F.col("_parts"))) for end in ("lo", "hi"))
        low = (F.col(f"_c{a}") * F.col("_parts")).cast("long")
        out = out.withColumn(f"_p{a}", F.explode(F.sequence(F.greatest(first, low), F.least(last, low + F.col("_parts").cast("long") - 1))))
    own = F.pmod(F.xxhash64(f"{side}_id"), F.coalesce(f"_{side}_shares", F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(f"_{other}_shares", F.lit(1)) - 1))
    return out.withColumn(f"_{side}_share", own).withColumn(f"_{other}_share", every).drop("_cuts", "_l_shares", "_r_shares")


def cell_pairs(left: DataFrame, right: DataFrame, margin: float = 0.0, cell: float = CELL, hot_rows: int = 200_000) -> DataFrame:
    """Pairs that share a part of a cell at the coarser of their sizes, boxes not yet compared; a pair may share several."""
    a, b = _levelled(left, "l_", cell, margin), _levelled(right, "r_", cell, 0.0)
    # A level for each fourfold size: a few dozen numbers at most from each side, none from points.
    a_levels, b_levels = (df.agg(F.collect_set(c)).scalar() for df, c in ((a, "_l_level"), (b, "_r_level")))
    finest = F.coalesce(F.array_min(F.array_union(a_levels, b_levels)), F.lit(0))
    mine, theirs = _in_cells(a, "l_", b_levels, cell, finest), _in_cells(b, "r_", a_levels, cell, finest)
    crowds = checkpointed(_crowds(mine, theirs, hot_rows))  # counted once for both sides
    pairs = _quartered(mine, "l", crowds).join(_quartered(theirs, "r", crowds).drop("_size", "_parts"), [*_CELL, "_px", "_py", "_l_share", "_r_share"])
    return pairs.filter(F.col("_level") == F.coalesce(F.greatest("_l_level", "_r_level"), finest))


def candidate_pairs(left: DataFrame, right: DataFrame, margin: float = 0.0, cell: float = CELL,
                    hot_rows: int = 200_000, by_shape: bool = False) -> DataFrame:
    """Pairs whose boxes come within `margin`, each once, columns prefixed `l_` and `r_`.

    Of geometries, `by_shape` lists the rows of equal ones: `l_geom` and `r_geom` with the lists `l_id` and `r_id`, for `each_pair`.
    """
    if by_shape:
        return blocks.shapes_in_blocks(left, right, margin, cell, hot_rows)
    if "geometry" in (kind_of(left), kind_of(right)):
        every = lambda shapes, a, b: np.ones(len(a), bool)
        return blocks.pairs_in_blocks(left, right, every, lambda met: met, {}, None, margin, cell, hot_rows)
    pairs = cell_pairs(left, right, margin, cell, hot_rows)
    meet = ((F.col("_l_lox") <= F.col("_r_hix")) & (F.col("_l_hix") >= F.col("_r_lox"))
            & (F.col("_l_loy") <= F.col("_r_hiy")) & (F.col("_l_hiy") >= F.col("_r_loy")))
    # The pair belongs to the part of a cell that holds the lower left corner of its common box.
    corner = [F.floor(F.greatest(f"_l_lo{a}", f"_r_lo{a}") / (F.col("_size") / F.col("_parts"))) == F.col(f"_p{a}") for a in "xy"]
    kept = pairs.filter(meet & corner[0] & corner[1])
    return kept.select(*[c for c in kept.columns if not c.startswith("_")])


def spatial_join(left: DataFrame, right: DataFrame, predicate: str = "intersects", keep: list[str] | None = None,
                 also: tuple[str, ...] = (), **grid) -> DataFrame:
    """Inner join of two tables with unique ids on a spatial predicate (disjoint: see `spatial_semi`).

    `keep` names the `l_` and `r_` columns wanted, all without it, and `also` further predicates to add as boolean columns.
    With geometries, between boxes and of points in boxes, `listed=True` gives pairs as lists, for `each_pair`.
    """
    if predicate == "disjoint":
        raise ValueError("disjoint pairs are all others; use spatial_semi(..., anti=True)")
    kinds = kind_of(left), kind_of(right)
    if "geometry" in kinds:
        test, wanted = related(predicate, kinds, also)
        extras = {name: (BooleanType(), _has(name)) for name in also}
        return blocks.pairs_in_blocks(left, right, test, wanted, extras, keep, **grid)
    named = {predicate, *also}
    if not grid.get("margin") and (kinds == ("box", "box") and "disjoint" not in named or kinds == ("point", "box") and named <= {"intersects", "within", "touches"}):
        extras = {name: (BooleanType(), _has(name)) for name in also}
        return blocks.pairs_in_blocks(left, right, blocks.box_relation_of(kinds, list(named)), _has(predicate), extras, keep, **grid)
    pairs = candidate_pairs(left, right, **grid).filter(exact_test(predicate, *kinds))
    return pairs.select(*(keep or pairs.columns), *[exact_test(name, *kinds).alias(name) for name in also])


def _has(name: str):
    return lambda bits: (bits & (1 << PREDICATES.index(name))) != 0


def related(predicate: str, kinds: tuple[str, str], also: tuple[str, ...] = ()):
    """Test of pairs of shapes in blocks, and which of its values mean that the predicate holds."""
    return blocks.relation_of(kinds, [predicate, *also]), _has(predicate)


def spatial_semi(left: DataFrame, right: DataFrame, predicate: str = "intersects", anti: bool = False,
                 **grid) -> DataFrame:
    """Rows of `left` that have a partner; with `anti`, those that have none.

    `disjoint` means disjoint from every row of `right`.
    """
    if predicate == "disjoint":
        predicate, anti = "intersects", not anti
    kinds = kind_of(left), kind_of(right)
    if "geometry" in kinds:
        hits = blocks.partners_in_blocks(left, right, *related(predicate, kinds), **grid)
    else:
        hits = spatial_join(left, right, predicate, **grid)
    hits = hits.select(F.col("l_id").alias("id")).distinct()
    return left.join(hits, "id", "left_anti" if anti else "left_semi")


def spatial_filter(df: DataFrame, predicate: str, geom: Column, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Rows in a relation to one constant geometry whose box is `bounds` (minx, miny, maxx, maxy)."""
    boxed = with_box(df)
    pre = bbox_filter(boxed, *bounds) if predicate != "disjoint" else boxed
    renamed = pre.select(*[F.col(c).alias("l_" + c) for c in pre.columns]).withColumn("r_geom", geom)
    kept = renamed.filter(exact_test(predicate, kind_of(df), "geometry"))
    return kept.select(*[F.col("l_" + c).alias(c) for c in df.columns])


def distance_join(left: DataFrame, right: DataFrame, limit: float, keep: list[str] | None = None, **grid) -> DataFrame:
    """Pairs no farther apart than `limit`, with their `distance`; of geometries with the `l_` and `r_` columns in `keep` only, if given."""
    kinds = kind_of(left), kind_of(right)
    if "geometry" in kinds:
        return blocks.pairs_in_blocks(left, right, blocks.gap_of(kinds), lambda gaps: gaps <= limit, {"distance": (DoubleType(), lambda gaps: gaps)},
                                      keep, margin=limit, **grid)
    pairs = candidate_pairs(left, right, margin=limit, **grid)
    if kinds == ("point", "point"):
        gap = F.hypot(F.col("l_x") - F.col("r_x"), F.col("l_y") - F.col("r_y"))
    else:
        gap = F.hypot(*[F.greatest(F.lit(0.0), F.col(f"l_min{a}") - F.col(f"r_max{a}"),
                                   F.col(f"r_min{a}") - F.col(f"l_max{a}")) for a in "xy"])
    near = pairs.withColumn("distance", gap).filter(F.col("distance") <= limit)
    return near.select(*keep, "distance") if keep else near


def beyond(left: DataFrame, right: DataFrame, limit: float, **grid) -> DataFrame:
    """Rows of `left` farther than `limit` from every row of `right`."""
    kinds = kind_of(left), kind_of(right)
    if "geometry" in kinds:
        near = blocks.partners_in_blocks(left, right, blocks.gap_of(kinds), lambda gaps: gaps <= limit, margin=limit, **grid)
    else:
        near = distance_join(left, right, limit, **grid)
    near = near.select(F.col("l_id").alias("id")).distinct()
    return left.join(near, "id", "left_anti")
