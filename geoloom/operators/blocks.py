"""Spatial joins whose exact test needs vertices, worked out block by block.

Both sides go to their grid cells by one shuffle, each row once a cell; a cell with very many rows is dealt into shares. A task reads
its cells in order, a bounded block at a time: rows of equal shape form a unit, units whose boxes meet are tested
in NumPy. What was found comes as lists, some rows of the left side with all rows of the right side they are paired with, and the JVM
makes a row of each pair. So no pair is ever shuffled or sent, and no geometry unless it is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from geoloom.functions import geometry as g
from geoloom.operators import relate as rel

BLOCK_ROWS = 20_000  # rows of a side in one share of a cell, and rows of small cells that are looked at together
ROW_VERTICES = 32  # so many vertices weigh like one more row
OUT_ROWS = 50_000  # rows written at once
TASK_ROWS = 25 * BLOCK_ROWS  # rows that go to one task, so that it can order them in memory
LIST_ROWS = 256  # rows of a side in one list; two lists give their product
SEGMENTS_AT_ONCE = 1_000_000
LAST_CELL = 2 ** 63 - 1  # of a point at infinity
PART = ["_level", "_cx", "_cy", "_l_share", "_r_share"]
_LO_HI = ["lox", "loy", "hix", "hiy"]
_AT = {"point": ["x", "y"], "box": ["minx", "miny", "maxx", "maxy"], "geometry": ["geom"]}


# --- rows to shapes ---

def _points(x, y):
    """(dimensions, xs, ys, ring sizes) of distinct points, and which of them each row is."""
    spots, which = np.unique(np.column_stack((x, y)) + 0.0, axis=0, return_inverse=True)
    return (np.zeros(len(spots), int), spots[:, :1], spots[:, 1:], np.ones((len(spots), 1), int)), which.ravel()


def _rectangles(box):
    spots, which = np.unique(box + 0.0, axis=0, return_inverse=True)
    return (np.full(len(spots), 2), spots[:, [0, 2, 2, 0, 0]], spots[:, [1, 1, 3, 3, 1]], np.full((len(spots), 1), 5)), which.ravel()


def _geometries(geom):
    """The same for geometry columns; shapes are equal when kinds of dimension, rings and vertices are."""
    n_items = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(int)
    ends = lambda counts, inner: np.concatenate(([0], inner))[np.concatenate(([0], np.cumsum(counts)))]
    kind = pc.struct_field(geom, "kind")
    dims = np.where(_mask(pc.ends_with(kind, "POLYGON")), 2, np.where(_mask(pc.ends_with(kind, "LINESTRING")), 1, 0))
    members = pc.struct_field(geom, "parts")
    rings = members.flatten()
    ring = rings.flatten()
    vertices = ring.flatten()
    x, y = (pc.struct_field(vertices, a).to_numpy(zero_copy_only=False).astype(float) for a in "xy")
    sizes = n_items(ring)
    ring_at = ends(n_items(members), np.cumsum(n_items(rings)))  # first ring of each row
    vertex_at = np.concatenate(([0], np.cumsum(sizes)))[ring_at]
    known, which = {}, np.zeros(len(dims), int)
    for k in range(len(dims)):
        p, q, r, s = vertex_at[k], vertex_at[k + 1], ring_at[k], ring_at[k + 1]
        which[k] = known.setdefault((dims[k], x[p:q].tobytes(), y[p:q].tobytes(), sizes[r:s].tobytes()), (len(known), k))[0]
    first = [k for _, k in known.values()]
    return (dims[first], [x[vertex_at[k]:vertex_at[k + 1]] for k in first], [y[vertex_at[k]:vertex_at[k + 1]] for k in first],
            [sizes[ring_at[k]:ring_at[k + 1]] for k in first]), which


def _mask(values):
    return pc.fill_null(values, False).to_numpy(zero_copy_only=False)


def _numbers(table, *names):
    return [table[n].to_numpy().astype(float) for n in names]


def _boxes(table, prefix: str):
    """Distinct boxes, and which of them each row has; NaN counts as the largest number, as in the JVM."""
    names = [prefix + c for c in _AT["box"]]
    names = names if set(names) <= set(table.column_names) else [prefix + c for c in "xyxy"]
    box = np.column_stack(_numbers(table, *names)) + 0.0
    box[np.isnan(box)] = np.inf
    order = np.lexsort(box.T)
    new = np.concatenate(([True], (box[order][1:] != box[order][:-1]).any(axis=1)))
    which = np.empty(len(box), int)
    which[order] = np.cumsum(new) - 1
    return (box[order[new]],), which


def _shapes(table, prefix: str, kind: str):
    if kind == "geometry":
        return _geometries(table[prefix + "geom"].combine_chunks())
    columns = _numbers(table, *[prefix + c for c in _AT[kind]])
    return _points(*columns) if kind == "point" else _rectangles(np.column_stack(columns))


class _Side:
    """Rows of one side of a block as units: rows of one part that have one shape."""

    def __init__(self, table, prefix: str, kind: str, part):
        plain = f"_{prefix}lox" not in table.column_names  # boxes and points alone, which are their own boxes
        self.table, (self.shapes, which) = table, _boxes(table, prefix) if plain else _shapes(table, prefix, kind)
        code = part * len(self.shapes[0]) + which
        codes, first, self.unit = np.unique(code, return_index=True, return_inverse=True)
        self.unit = self.unit.ravel()
        self.part, self.shape = codes // len(self.shapes[0]), which[first]
        self.box = self.shapes[0][self.shape] if plain else np.column_stack(_numbers(table, *[f"_{prefix}{c}" for c in _LO_HI]))[first]
        self.level, self.size, *cell = (table[c].to_numpy()[first] for c in (f"_{prefix}own", "_size", "_cx", "_cy"))
        self.cell, self.at = np.column_stack(cell), table["_level"].to_numpy()[first]
        self.count = np.bincount(self.unit, minlength=len(codes))
        self.start = np.cumsum(self.count) - self.count
        self.rows = np.argsort(self.unit, kind="stable")
        self.weight = np.ones(len(codes), int)


# --- exact tests of pairs of shapes ---

def _cuts(weights, most: int) -> Iterator[slice]:
    """Runs of items that weigh no more than `most` together, one item at least."""
    ends, at = np.cumsum(weights), 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, stop)
        at = stop


def _spots(shapes, chosen):
    return shapes.pts.rows[shapes.pts.starts[chosen]]


def _place_points(shapes, points, areas):
    """1 inside, 0 on the boundary, -1 outside, for the points and the geometries of each pair; as `_place_point` on columns."""
    out, dim = np.full(len(points), -1), shapes.dim[areas]
    n_segs = np.diff(shapes.segs.starts)[areas]
    for cut in _cuts(n_segs + 1, SEGMENTS_AT_ONCE):
        p = _spots(shapes, points[cut])
        segs, pair = shapes.segs.of(areas[cut])
        n = cut.stop - cut.start
        if len(segs):
            x1, y1, x2, y2 = segs[:, :4].T
            x, y = p[pair].T
            reach = g.NEAR * np.maximum(1.0, np.abs(np.column_stack((x, y, x1, y1, x2, y2))).max(axis=1))
            dx, dy = x2 - x1, y2 - y1
            on = ((np.abs(dx * (y - y1) - dy * (x - x1)) <= reach * np.hypot(dx, dy)) & (x >= np.minimum(x1, x2) - reach)
                  & (x <= np.maximum(x1, x2) + reach) & (y >= np.minimum(y1, y2) - reach) & (y <= np.maximum(y1, y2) + reach))
            with np.errstate(divide="ignore", invalid="ignore"):
                crossed = ((y1 > y) != (y2 > y)) & (x < dx * (y - y1) / dy + x1)
            on, odd = np.bincount(pair[on], minlength=n) > 0, np.bincount(pair[crossed], minlength=n) % 2 == 1
        else:
            on, odd = np.zeros(n, bool), np.zeros(n, bool)
        same = []
        for listed in (shapes.ends, shapes.pts):
            rows, at = rel._only(listed, areas[cut], dim[cut] == (1 if listed is shapes.ends else 0))
            same.append(np.bincount(at[(rows == p[at]).all(axis=1)], minlength=n) > 0)
        area = np.where(on, 0, np.where(odd, 1, -1))
        line = np.where(~on, -1, np.where(same[0], 0, 1))
        out[cut] = np.where(dim[cut] == 2, area, np.where(dim[cut] == 1, line, np.where(same[1], 1, -1)))
    return out


def _point_gaps(shapes, points, others):
    """Distance of the point to the geometry of each pair, 0 inside an area; as `point_to_geometry` on columns."""
    out = np.zeros(len(points))
    apart = np.flatnonzero(~((shapes.dim[others] == 2) & (_place_points(shapes, points, others) >= 0)))
    n_walls = np.diff(shapes.walls.starts)[others[apart]]
    for cut in _cuts(n_walls, SEGMENTS_AT_ONCE):
        walls, pair = shapes.walls.of(others[apart[cut]])
        gaps = rel._gaps(_spots(shapes, points[apart[cut]])[pair], walls[:, :4])
        least = np.full(cut.stop - cut.start, np.inf)
        np.minimum.at(least, pair, gaps)
        out[apart[cut]] = least
    return out


def _in_turns(test, shapes, a, b):
    found = [test(shapes, a[cut], b[cut]) for cut in _cuts(shapes.count[a] + shapes.count[b], rel.VERTICES_AT_ONCE)]
    return np.concatenate(found) if found else np.zeros(0, int)


_BIT = {name: 1 << k for k, name in enumerate(rel.PREDICATES)}


def box_relation_of(kinds: tuple[str, str], names: list[str]) -> Callable:
    """The same for boxes, or points in boxes; as `spatial.exact_test` on columns."""
    bits = lambda **found: sum(np.where(found[n], _BIT[n], 0) for n in names if n in found)

    def point_in_box(boxes, a, b):
        (x, y), box = boxes[a, :2].T, boxes[b]
        meet = (x <= box[:, 2]) & (x >= box[:, 0]) & (y <= box[:, 3]) & (y >= box[:, 1])
        inside = (x > box[:, 0]) & (x < box[:, 2]) & (y > box[:, 1]) & (y < box[:, 3])
        return bits(intersects=meet, within=inside, touches=meet & ~inside)

    def box_by_box(boxes, a, b):
        p, q = boxes[a], boxes[b]
        meet, inside, around, share, thick, sizes = True, True, True, True, 0, [0, 0]
        for k in (0, 1):
            a1, a2, b1, b2 = p[:, k], p[:, k + 2], q[:, k], q[:, k + 2]
            low, high, flat_a, flat_b = np.maximum(a1, b1), np.minimum(a2, b2), a1 == a2, b1 == b2
            meet, inside, around = meet & (low <= high), inside & (a1 >= b1) & (a2 <= b2), around & (a1 <= b1) & (a2 >= b2)
            inner = np.where(flat_a & flat_b, a1 == b1, np.where(flat_a, (a1 > b1) & (a1 < b2), np.where(flat_b, (b1 > a1) & (b1 < a2), low < high)))
            share, thick = share & inner, thick + (low < high)
            sizes = [sizes[0] + ~flat_a, sizes[1] + ~flat_b]
        within, contains = inside & share, around & share
        apart = share & ~within & ~contains
        return bits(intersects=meet, within=within, contains=contains, equals=inside & around, touches=meet & ~share,
                    overlaps=apart & (sizes[0] == sizes[1]) & (thick == sizes[0]), crosses=apart & ((sizes[0] != sizes[1]) | (thick < sizes[0])))

    return point_in_box if kinds[0] == "point" else box_by_box


def relation_of(kinds: tuple[str, str], names: list[str]) -> Callable:
    """Test giving bits of the predicates that hold; a point against a geometry as on columns, where these predicates allow it."""
    if kinds[0] == "point" and set(names) <= {"intersects", "within", "touches"}:
        def by_place(shapes, a, b):
            place = _place_points(shapes, a, b)
            return np.where(place >= 0, _BIT["intersects"], 0) | np.where(place == 1, _BIT["within"], 0) | np.where(place == 0, _BIT["touches"], 0)
        return by_place
    return lambda shapes, a, b: _in_turns(rel._relate, shapes, a, b)


def gap_of(kinds: tuple[str, str]) -> Callable:
    if kinds[0] == "point":
        return _point_gaps
    if kinds[1] == "point":
        return lambda shapes, a, b: _point_gaps(shapes, b, a)
    return lambda shapes, a, b: _in_turns(rel._separation, shapes, a, b)


# --- blocks ---

def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole parts that have BLOCK_ROWS rows together, and the number of each row's part."""
    held, rows = [], 0

    def numbered(table):
        keys = [table[c].to_numpy() for c in PART]
        return np.concatenate(([0], np.cumsum(np.any([k[1:] != k[:-1] for k in keys], axis=0))))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            table = pa.Table.from_batches(held)
            part = numbered(table)
            cut = int(np.searchsorted(part, part[-1]))  # the last part may go on
            if cut:
                yield table.slice(0, cut), part[:cut]
                held = table.slice(cut).to_batches()
                rows -= cut
    if held:
        table = pa.Table.from_batches(held)
        yield table, numbered(table)


def _hits(left: _Side, right: _Side, shapes, test: Callable, wanted: Callable, seen=None):
    """Blocks of (left unit, right unit, value) of the pairs that the test finds. Units marked in `seen` are done with."""
    offset = len(left.shapes[0])
    for i, j in rel._grouped_pairs(left.box, left.part, right.box, right.part):
        # A pair belongs to the coarser of its sizes, and there to the cell that holds the lower left corner of its common box.
        low = np.maximum(left.box[i, :2], right.box[j, :2])
        corner = np.floor(np.where(np.isfinite(low), low, 0.0) / left.size[i, None]).astype(np.int64)
        corner = np.where(np.isposinf(low) & (left.cell[i] == LAST_CELL), LAST_CELL, corner)
        mine = (np.maximum(left.level[i], right.level[j]) == left.at[i]) & (corner == left.cell[i]).all(axis=1)
        if seen is not None:
            mine &= ~seen[i]
        i, j = i[mine], j[mine]
        if not len(i):
            continue
        value = test(shapes, left.shape[i], right.shape[j] + offset)
        kept = wanted(value)
        yield i[kept], j[kept], value[kept]


def _pieces(side: _Side, units):
    """(index in `units`, first row, rows) of the rows of units, LIST_ROWS or so many as weigh that at once."""
    each = np.maximum(1, LIST_ROWS // side.weight[units])
    k, piece = rel._expanded(np.zeros(len(units), int), -(-side.count[units] // each))
    return k, side.start[units[k]] + piece * each[k], np.minimum(each[k], side.count[units[k]] - piece * each[k])


def _listed(left: _Side, right: _Side, i, j) -> Iterator[tuple[np.ndarray, ...]]:
    """(left rows, how many a list, right rows, how many a list, place in i and j of each right row) of pairs of units, about OUT_ROWS a block.
    Each row of a left list is paired with each of the right list beside it."""
    order = np.argsort(i, kind="stable")
    hit, first, n = _pieces(right, j[order])
    hit = order[hit]
    weight = n * right.weight[j[hit]]
    for cut in _cuts(weight, OUT_ROWS):
        units, before = i[hit[cut]], np.cumsum(weight[cut]) - weight[cut]
        opens = np.concatenate(([True], units[1:] != units[:-1]))
        filled = (before - before[opens][np.cumsum(opens) - 1]) // LIST_ROWS
        begins = np.flatnonzero(opens | np.concatenate(([False], filled[1:] != filled[:-1])))
        piece, at = rel._expanded(first[cut], n[cut])
        r_rows, place = right.rows[at], hit[cut][piece]
        sizes = np.add.reduceat(n[cut], begins)
        starts = np.cumsum(sizes) - sizes
        k, l_first, l_n = _pieces(left, units[begins])
        for some in _cuts(np.add.reduceat(weight[cut], begins)[k] + l_n * left.weight[units[begins[k]]], 2 * OUT_ROWS):
            _, l_at = rel._expanded(l_first[some], l_n[some])
            _, r_at = rel._expanded(starts[k[some]], sizes[k[some]])
            yield left.rows[l_at], l_n[some], r_rows[r_at], sizes[k[some]], place[r_at]


def _lists(values: pa.Array, rows, sizes) -> pa.Array:
    """Lists of the values of some rows."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values.take(pa.array(rows)))


def each_pair(listed: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """A row for each item of the left lists with each item of the right lists beside it; other columns stay as they are. A side without names stays listed."""
    for at, names in ((at, names) for at, names in (("_l_at", left), ("_r_at", right)) if names):
        first = listed.select("*", F.posexplode(names[0]).alias(at, "_item"))
        listed = first.select(*[(F.col("_item") if c == names[0] else F.get(c, F.col(at))).alias(c) if c in names else F.col(c) for c in listed.columns])
    return listed


def _both(table, part, kinds):
    side = table["_side"].to_numpy()
    if not side.any() or side.all():
        return None
    left, right = (_Side(table.filter(pa.array(side == s)), p, k, part[side == s]) for s, p, k in ((0, "l_", kinds[0]), (1, "r_", kinds[1])))
    plain = len(left.shapes) == 1
    shapes = np.concatenate((*left.shapes, *right.shapes)) if plain else rel.Shapes(*([*a, *b] for a, b in zip(left.shapes, right.shapes)))
    return left, right, shapes


def _placed(left: DataFrame, right: DataFrame, keep: list[str], margin: float, cell: float, block_rows: int) -> DataFrame:
    """Rows of both sides, once a covered cell, with `_side` 0 or 1, each task's in the order of their parts."""
    from geoloom.operators import spatial as sp

    a, b = sp._levelled(left, "l_", cell, margin), sp._levelled(right, "r_", cell, 0.0)
    none = F.lit(sp.FINEST - 1)  # marks rows without extent
    a_seen, b_seen = (df.agg(F.collect_set(F.coalesce(c, none))).scalar() for df, c in ((a, "_l_level"), (b, "_r_level")))
    a_levels, b_levels = (F.array_remove(seen, none) for seen in (a_seen, b_seen))
    finest = F.coalesce(F.array_min(F.array_union(a_levels, b_levels)), F.lit(0))
    kinds = sp.kind_of(left), sp.kind_of(right)
    sides, plain = [], "geometry" not in kinds and not margin
    for source, df, p, levels, seen, kind in ((left, a, "l_", b_levels, b_seen, kinds[0]), (right, b, "r_", a_levels, a_seen, kinds[1])):
        lowest = F.when(F.array_contains(seen, none), finest).otherwise(F.array_min(levels))
        weight = F.lit(1) + (F.floor(g.num_points(F.col(p + "geom")) / ROW_VERTICES) if kind == "geometry" else F.lit(0))
        at = _AT["box"] if plain and not (kind == "point" and not set(sp.BOX) <= set(source.columns)) else _AT[kind]
        carried = list(dict.fromkeys([c for c in keep if c.startswith(p)] + [p + c for c in at]))
        ready = df.select(*carried, *[f"_{p}{c}" for c in _LO_HI], F.col(f"_{p}level"), F.coalesce(f"_{p}level", finest).alias(f"_{p}own"),
                          F.xxhash64(p + "id", *[f"_{p}{c}" for c in _LO_HI]).alias("_hash"), weight.alias("_weight"))
        # A row's own size is of use only if the other side has rows of it or finer ones.
        placed = sp._in_cells(ready, p, levels, cell, finest).filter((F.col("_level") > F.col(f"_{p}own")) | (F.col("_level") >= lowest))
        sides.append(placed.drop(f"_{p}level", *[f"_{p}{c}" for c in _LO_HI] if plain else []))
    return _dealt(sides, block_rows)


def _dealt(sides: list[DataFrame], block_rows: int) -> DataFrame:
    """Rows of both sides in the order of their parts: a cell with more than `block_rows` rows of a side is dealt into shares by `_hash`.

    Such cells are broadcast: there is at most one for each `block_rows` rows of a side.
    """
    from geoloom.session import checkpointed

    cells = [df.select("_level", "_cx", "_cy", *[(F.col("_weight") if k == s else F.lit(0)).alias(n) for k, n in enumerate("lr")]) for s, df in enumerate(sides)]
    sums = cells[0].unionByName(cells[1]).groupBy("_level", "_cx", "_cy").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    share = lambda n: F.ceil(F.col(n) / block_rows).cast("int").alias(f"_{n}_shares")
    told = Observation()
    counted = sums.observe(told, F.sum(F.col("l") + F.col("r")).alias("rows"))
    crowds = checkpointed(counted.filter((F.col("l") > 0) & (F.col("r") > 0) & ((F.col("l") > block_rows) | (F.col("r") > block_rows)))
                          .select("_level", "_cx", "_cy", share("l"), share("r")))
    dealt = []
    for side, df in enumerate(sides):
        own, other = ("l", "r") if side == 0 else ("r", "l")
        shares = df.join(F.broadcast(crowds), ["_level", "_cx", "_cy"], "left")
        shares = shares.withColumn(f"_{own}_share", F.pmod("_hash", F.coalesce(f"_{own}_shares", F.lit(1))).cast("int")).withColumn(
            f"_{other}_share", F.explode(F.sequence(F.lit(0), F.coalesce(f"_{other}_shares", F.lit(1)) - 1)))
        dealt.append(shares.drop("_l_shares", "_r_shares", "_hash", "_weight").withColumn("_side", F.lit(side)))
    spark = sides[0].sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-(told.get["rows"] or 0) // TASK_ROWS))
    return dealt[0].unionByName(dealt[1], allowMissingColumns=True).repartition(tasks, *PART).sortWithinPartitions(*PART)


def _types(df: DataFrame, prefix: str) -> dict[str, StructField]:
    from geoloom.operators.spatial import with_box

    return {prefix + f.name: StructField(prefix + f.name, f.dataType) for f in with_box(df).schema}


def pairs_in_blocks(left: DataFrame, right: DataFrame, test: Callable, wanted: Callable, extras: dict[str, tuple], keep: list[str] | None = None,
                    margin: float = 0.0, cell: float = 0.25, hot_rows: int = BLOCK_ROWS, listed: bool = False) -> DataFrame:
    """Rows of the pairs that the test finds, with the columns `keep` (all if None) and `extras`: name to (type, function of the values).

    With `listed` the columns are lists: each item of the `l_` lists of a row is paired with each of the others.
    """
    from geoloom.operators.spatial import kind_of

    kinds, known = (kind_of(left), kind_of(right)), {**_types(left, "l_"), **_types(right, "r_")}
    names = list(known) if keep is None else keep
    l_names, r_names = ([n for n in names if n.startswith(p)] or [f"_{p}"] for p in ("l_", "r_"))  # a list of nothing counts the rows of a side

    def run(batches):
        for table, part in _blocks(batches):
            block = _both(table, part, kinds)
            if block is None:
                continue
            a, b, shapes = block
            columns = {}
            for side, p, offset in ((a, "l_", 0), (b, "r_", len(a.shapes[0]))):
                columns |= {n: side.table[n].combine_chunks() for n in names if n.startswith(p)} or {f"_{p}": pa.nulls(len(side.table), pa.bool_())}
                if p + "geom" in names:
                    side.weight = 1 + shapes.count[side.shape + offset] // ROW_VERTICES
            for i, j, value in _hits(a, b, shapes, test, wanted):
                for x, nx, y, ny, k in _listed(a, b, i, j):
                    lists = {n: _lists(c, x, nx) if n in l_names else _lists(c, y, ny) for n, c in columns.items()}
                    lists |= {n: _lists(pa.array(make(value[k])), np.arange(len(k)), ny) for n, (_, make) in extras.items()}
                    yield pa.RecordBatch.from_arrays(list(lists.values()), list(lists))

    of = {**known, "_l_": StructField("_l_", BooleanType()), "_r_": StructField("_r_", BooleanType()), **{n: StructField(n, kind) for n, (kind, _) in extras.items()}}
    schema = StructType([StructField(n, ArrayType(of[n].dataType)) for n in (*l_names, *r_names, *extras)])
    lists = _placed(left, right, names, margin, cell, hot_rows).mapInArrow(run, schema)
    return lists if listed else each_pair(lists, l_names, [*r_names, *extras]).select(*names, *extras)


def shapes_in_blocks(left: DataFrame, right: DataFrame, margin: float = 0.0, cell: float = 0.25, hot_rows: int = BLOCK_ROWS) -> DataFrame:
    """Geometries of both sides whose boxes come within `margin`, `l_geom` and `r_geom`, with the lists `l_id` and `r_id` of the rows that have just these,
    the predicates' view of them: dimension, rings and vertices. Lists end after LIST_ROWS rows and with a block."""
    kinds, known = ("geometry", "geometry"), {**_types(left, "l_"), **_types(right, "r_")}
    every = lambda shapes, a, b: np.ones(len(a), bool)
    names = ["l_id", "r_id", "l_geom", "r_geom"]

    def run(batches):
        for table, part in _blocks(batches):
            block = _both(table, part, kinds)
            if block is None:
                continue
            a, b, shapes = block
            columns = {n: side.table[n].combine_chunks() for side, p in ((a, "l_"), (b, "r_")) for n in (p + "id", p + "geom")}
            weigh = lambda units, side, offset: 1 + shapes.count[side.shape[units] + offset] // ROW_VERTICES
            for i, j, _ in _hits(a, b, shapes, every, lambda met: met):
                p, l_first, l_n = _pieces(a, i)
                q, r_first, r_n = _pieces(b, j)
                q_from, q_n = np.searchsorted(q, np.arange(len(j))), np.bincount(q, minlength=len(j))
                x, y = rel._expanded(q_from[p], q_n[p])  # each left piece of a pair with each right piece of it
                hit = p[x]
                for cut in _cuts(l_n[x] + r_n[y] + weigh(i[hit], a, 0) + weigh(j[hit], b, len(a.shapes[0])), OUT_ROWS):
                    lists = []
                    for side, column, first, n, at in ((a, "l_id", l_first, l_n, x[cut]), (b, "r_id", r_first, r_n, y[cut])):
                        lists.append(_lists(columns[column], side.rows[rel._expanded(first[at], n[at])[1]], n[at]))
                    geoms = [columns[n].take(pa.array(side.rows[side.start[units[hit[cut]]]])) for n, side, units in (("l_geom", a, i), ("r_geom", b, j))]
                    yield pa.RecordBatch.from_arrays([*lists, *geoms], names)

    schema = StructType([*[StructField(n, ArrayType(known[n].dataType)) for n in names[:2]], *[known[n] for n in names[2:]]])
    return _placed(left, right, names, margin, cell, hot_rows).mapInArrow(run, schema)


def partners_in_blocks(left: DataFrame, right: DataFrame, test: Callable, wanted: Callable, margin: float = 0.0, cell: float = 0.25,
                       hot_rows: int = BLOCK_ROWS) -> DataFrame:
    """`l_id` of left rows that have a partner, once a block; a unit with a partner is not tested again there."""
    from geoloom.operators.spatial import kind_of

    kinds, known = (kind_of(left), kind_of(right)), _types(left, "l_")

    def run(batches):
        for table, part in _blocks(batches):
            block = _both(table, part, kinds)
            if block is None:
                continue
            a, b, shapes = block
            seen = np.zeros(len(a.count), bool)
            for i, _, _ in _hits(a, b, shapes, test, wanted, seen):
                seen[i] = True
            yield from a.table.select(["l_id"]).filter(pa.array(seen[a.unit])).combine_chunks().to_batches()

    return _placed(left, right, ["l_id"], margin, cell, hot_rows).mapInArrow(run, StructType([known["l_id"]]))


def sums_in_blocks(left: DataFrame, right: DataFrame, value: str, test: Callable, wanted: Callable, margin: float = 0.0, cell: float = 0.25,
                   hot_rows: int = BLOCK_ROWS) -> DataFrame:
    """Of each right row and block the `rows`, and `n`, `low`, `high`, `total`, `mean` and squares about it (`m2`) of the left partners' values (doubles)."""
    from geoloom.operators.spatial import kind_of

    kinds, known = (kind_of(left), kind_of(right)), _types(right, "r_")
    names = ["rows", "n", "low", "high", "total", "mean", "m2"]

    def run(batches):
        for table, part in _blocks(batches):
            block = _both(table, part, kinds)
            if block is None:
                continue
            a, b, shapes = block
            v = a.table["l_" + value].to_numpy().astype(float)
            full = ~a.table["l_" + value].combine_chunks().is_null().to_numpy(zero_copy_only=False)
            shift = np.nanmean(v[full]) if (full & ~np.isnan(v)).any() else 0.0
            units, u = len(a.count), a.unit[full]
            own = [np.bincount(a.unit, minlength=units), np.bincount(u, minlength=units),
                   *[np.bincount(u, w, minlength=units) for w in (v[full], v[full] - shift, (v[full] - shift) ** 2)]]
            low, high = np.full(units, np.nan), np.full(units, -np.inf)
            with np.errstate(invalid="ignore"):
                np.fmin.at(low, u, v[full])
                np.maximum.at(high, u, v[full])
            sums, lows, highs = [np.zeros(len(b.count)) for _ in own], np.full(len(b.count), np.nan), np.full(len(b.count), -np.inf)
            for i, j, _ in _hits(a, b, shapes, test, wanted):
                for into, part_sums in zip(sums, own):
                    into += np.bincount(j, part_sums[i], minlength=len(into))
                with np.errstate(invalid="ignore"):
                    np.fmin.at(lows, j, low[i])
                    np.maximum.at(highs, j, high[i])
            rows, n, total, first, second = sums
            met = np.flatnonzero(rows[b.unit] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                mean, m2 = shift + first / n, np.maximum(second - first * first / n, 0.0)
            none = n[b.unit[met]] == 0
            columns = [pa.array(c[b.unit[met]], mask=none) for c in (lows, highs, total, mean, m2)]
            counts = [pa.array(c[b.unit[met]].astype(np.int64)) for c in (rows, n)]
            yield from pa.table([b.table["r_id"].combine_chunks().take(pa.array(met)), *counts, *columns], ["r_id", *names]).to_batches()

    kinds_out = ["long", "long", *["double"] * 5]
    schema = StructType([known["r_id"]])
    for n, t in zip(names, kinds_out):
        schema = schema.add(n, t)
    return _placed(left, right, ["r_id", "l_" + value], margin, cell, hot_rows).mapInArrow(run, schema)


def nearest_in_blocks(queries: DataFrame, items: DataFrame, hot_rows: int = BLOCK_ROWS) -> DataFrame:
    """Of each query point (`id`, `x`, `y`, `bound`) in a cell (`level`, `cx`, `cy`) the geometries of that cell (`id`, `geom`, box) that may be its nearest
    there, by more than rounding: `qid`, `qx`, `qy`, `id`, `geom`. Of equal geometries the smallest id stands for all."""
    known = {f.name: f for f in items.schema}
    schema = StructType([StructField("qid", queries.schema["id"].dataType), StructField("qx", DoubleType()), StructField("qy", DoubleType()), known["id"], known["geom"]])
    place = [F.col("level").alias("_level"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), F.lit(1.0).alias("_size")]
    box = lambda p, *sides: [c.alias(f"_{p}{n}") for c, n in zip(sides, _LO_HI)]
    a = queries.select(*place, *[F.col(c).alias("l_" + c) for c in ("id", "x", "y")], F.lit(0).alias("_l_own"), *box(
        "l_", *[F.col(c) + way * F.col("bound") for way in (-1, 1) for c in "xy"]), F.xxhash64("id", "x", "y").alias("_hash"), F.lit(1).alias("_weight"))
    b = items.select(*place, *[F.col(c).alias("r_" + c) for c in ("id", "geom")], F.lit(0).alias("_r_own"), *box("r_", *map(F.col, ("minx", "miny", "maxx", "maxy"))),
                     F.xxhash64("id", "minx", "miny").alias("_hash"), (F.lit(1) + F.floor(g.num_points(F.col("geom")) / ROW_VERTICES)).alias("_weight"))

    def run(batches):
        for table, part in _blocks(batches):
            block = _both(table, part, ("point", "geometry"))
            if block is None:
                continue
            a, b, shapes = block
            ids = b.table["r_id"].combine_chunks()
            rank = np.empty(len(ids), int)
            rank[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
            first = np.lexsort((rank, b.unit))[b.start]  # the row of each unit that has its smallest id
            least, found = np.full(len(a.count), np.inf), []
            for i, j in rel._grouped_pairs(a.box, a.part, b.box, b.part):
                gaps = _point_gaps(shapes, a.shape[i], b.shape[j] + len(a.shapes[0]))
                np.minimum.at(least, i, gaps)
                near = gaps <= least[i] + 1e-9 * (1.0 + least[i])
                found.append((i[near], j[near], gaps[near]))
            if not found:
                continue
            i, j, gaps = (np.concatenate(c) for c in zip(*found))
            near = gaps <= least[i] + 1e-9 * (1.0 + least[i])
            i, j = i[near], j[near]
            l_rows, r_rows = (t.select(names).combine_chunks() for t, names in ((a.table, ["l_id", "l_x", "l_y"]), (b.table, ["r_id", "r_geom"])))
            ends = np.cumsum(a.count[i])
            for at in range(0, int(ends[-1]), OUT_ROWS):
                index = np.arange(at, min(at + OUT_ROWS, int(ends[-1])))
                k = np.searchsorted(ends, index, "right")
                mine = l_rows.take(pa.array(a.rows[a.start[i[k]] + index - ends[k] + a.count[i[k]]]))
                theirs = r_rows.take(pa.array(first[j[k]]))
                yield from pa.table([*mine.columns, *theirs.columns], ["qid", "qx", "qy", "id", "geom"]).combine_chunks().to_batches()

    return _dealt([a, b], hot_rows).mapInArrow(run, schema)
