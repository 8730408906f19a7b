"""Exact tests between two geometries, run on Arrow batches.

Both boundaries are cut where they meet; the pieces and cut points of each are then placed inside,
on or outside the other, and the named predicates follow from which combinations occur. Segments find each other by
their boxes through cells that fit them, so two shapes cost about their vertices and contacts, not their product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions import geometry as g

PREDICATES = ["intersects", "disjoint", "contains", "within", "equals", "touches", "crosses", "overlaps"]


PAIRS_AT_ONCE = 2_000_000  # candidate pairs looked at together, which bounds memory


def _in_cells(boxes, size, origin):
    """(item, cell) for each cell that a box of at most the cell's size covers."""
    lo, hi = (np.floor((boxes[:, k:k + 2] - origin) / size).astype(np.int64) for k in (0, 2))
    items, cells = [], []
    for dx in range(3):  # two a side but for rounding
        for dy in range(3):
            at = lo + (dx, dy)
            covered = np.flatnonzero((at <= hi).all(axis=1))
            items.append(covered)
            cells.append(at[covered])
    return np.concatenate(items), np.concatenate(cells)


def box_pairs(a, b):
    """Blocks of (index in a, index in b) of every two boxes (minx, miny, maxx, maxy) that meet, each pair once.

    Cells come in sizes that grow by four; a box goes to the size it fits, and two boxes meet at the coarser of theirs, in
    the cell that holds the lower left corner of what they share. So the work follows the boxes and their neighbours.
    """
    if not len(a) or not len(b):
        return
    if len(a) * len(b) <= 1 << 14:  # a plain table is quicker for few boxes
        yield np.nonzero(((a[:, None, :2] <= b[None, :, 2:]) & (b[None, :, :2] <= a[:, None, 2:])).all(axis=2))
        return
    extents = [np.maximum(x[:, 2] - x[:, 0], x[:, 3] - x[:, 1]) for x in (a, b)]
    every, origin = np.concatenate(extents), np.minimum(a[:, :2].min(axis=0), b[:, :2].min(axis=0))
    span = max((np.maximum(a[:, 2:].max(axis=0), b[:, 2:].max(axis=0)) - origin).max(), np.finfo(float).tiny)
    some = every[every > 0]
    cell = max(np.quantile(some, 0.1) if len(some) else span / np.sqrt(len(every)), span * 2.0 ** -40)
    la, lb = (np.ceil(np.log(np.maximum(e, cell) / cell) / np.log(4) - 1e-12).astype(int) for e in extents)
    for level in np.unique(np.concatenate((la, lb))):
        size = cell * 4.0 ** level * (1 + 1e-9)
        for mine, theirs in ((la == level, lb <= level), (la < level, lb == level)):
            i, j = np.flatnonzero(mine), np.flatnonzero(theirs)
            if not len(i) or not len(j):
                continue
            (ia, ca), (jb, cb) = _in_cells(a[i], size, origin), _in_cells(b[j], size, origin)
            ka, kb = (c[:, 0] * np.int64(0x9E3779B97F4A7C1) + c[:, 1] for c in (ca, cb))
            order = np.argsort(kb, kind="stable")
            first, last = (np.searchsorted(kb[order], ka, side) for side in ("left", "right"))
            ends = np.cumsum(last - first)
            at = 0
            while at < len(ka):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE)))
                counts = (last - first)[at:stop]
                x = np.repeat(np.arange(at, stop), counts)
                y = order[np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[at:stop], counts)]
                p, q = a[i[ia[x]]], b[j[jb[y]]]
                corner = np.floor((np.maximum(p[:, :2], q[:, :2]) - origin) / size).astype(np.int64)
                meet = (p[:, :2] <= q[:, 2:]).all(axis=1) & (q[:, :2] <= p[:, 2:]).all(axis=1) & (corner == ca[x]).all(axis=1) & (ca[x] == cb[y]).all(axis=1)
                yield i[ia[x[meet]]], j[jb[y[meet]]]
                at = stop


def _grouped_pairs(a, a_pair, b, b_pair):
    """box_pairs within each pair of shapes; both lists are in the order of their pairs. Small lists meet as a plain table, many tables at once."""
    if not len(a) or not len(b):
        return
    n = max(a_pair[-1], b_pair[-1]) + 1
    a_from, b_from = (np.searchsorted(p, np.arange(n + 1)) for p in (a_pair, b_pair))
    a_count, b_count = np.diff(a_from), np.diff(b_from)
    small = a_count * b_count <= 1 << 12
    rows = np.flatnonzero(small[a_pair] & (b_count[a_pair] > 0))
    ends = np.cumsum(b_count[a_pair[rows]])
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE)))
        x, y = _expanded(b_from[a_pair[rows[at:stop]]], b_count[a_pair[rows[at:stop]]])
        x = rows[at:stop][x]
        p, q = a[x], b[y]
        meet = (p[:, 0] <= q[:, 2]) & (q[:, 0] <= p[:, 2]) & (p[:, 1] <= q[:, 3]) & (q[:, 1] <= p[:, 3])
        yield x[meet], y[meet]
        at = stop
    for g in np.flatnonzero(~small):
        for i, j in box_pairs(a[a_from[g]:a_from[g + 1]], b[b_from[g]:b_from[g + 1]]):
            yield i + a_from[g], j + b_from[g]


def _expanded(starts, counts):
    """(index of a run, item) of all items of runs of given starts and lengths."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def _boxes(segs, eps=0.0):
    eps = np.reshape(eps, (-1, 1))
    return np.concatenate((np.minimum(segs[:, :2], segs[:, 2:]) - eps, np.maximum(segs[:, :2], segs[:, 2:]) + eps), axis=1)


def _dots(p, eps=0.0):
    eps = np.reshape(eps, (-1, 1))
    return np.concatenate((p - eps, p + eps), axis=1)


def _stabbed(ys, y_pair, segs, s_pair):
    """(index of a height, x where a segment of its pair spans it), in blocks."""
    flat = lambda lo, hi: np.column_stack((np.zeros(len(lo)), lo, np.zeros(len(lo)), hi))
    for i, j in _grouped_pairs(flat(ys, ys), y_pair, flat(np.minimum(segs[:, 1], segs[:, 3]), np.maximum(segs[:, 1], segs[:, 3])), s_pair):
        x1, y1, x2, y2 = segs[j].T
        span = (y1 > ys[i]) != (y2 > ys[i])
        i, x1, y1, x2, y2 = i[span], x1[span], y1[span], x2[span], y2[span]
        yield i, (x2 - x1) * (ys[i] - y1) / (y2 - y1) + x1


def _gaps(p, segs):
    """The distance of each position to the segment beside it."""
    x1, y1, x2, y2 = segs.T
    dx, dy = x2 - x1, y2 - y1
    sq = dx * dx + dy * dy
    t = np.clip(((p[..., 0] - x1) * dx + (p[..., 1] - y1) * dy) / np.where(sq == 0, 1.0, sq), 0, 1)
    return np.hypot(p[..., 0] - (x1 + t * dx), p[..., 1] - (y1 + t * dy))


def _ways(segs):
    x, y, ex, ey = segs.T
    return x, y, ex - x, ey - y


class _Listed:
    """Rows of an array by their owner, in the owners' order, and the rows of a choice of owners."""

    def __init__(self, rows, owner, owners):
        self.rows, self.owner = rows, owner
        self.starts = np.searchsorted(owner, np.arange(owners + 1))

    def of(self, chosen):
        """(rows, index in `chosen`) of every chosen owner, which may be chosen more than once."""
        pair, at = _expanded(self.starts[chosen], np.diff(self.starts)[chosen])
        return self.rows[at], pair


class Shapes:
    """Many geometries as flat arrays, each built once however many pairs it is in."""

    def __init__(self, dims, xs, ys, sizes):
        n = len(dims)
        self.dim = np.array(dims, int)
        count = np.array([len(x) for x in xs])
        pts = np.column_stack([np.concatenate([np.asarray(v, float) for v in c] or [np.zeros(0)]) for c in (xs, ys)])
        owner = np.repeat(np.arange(n), count)
        part = np.concatenate([np.asarray(v, int) for v in sizes] or [np.zeros(0, int)])
        part_owner = np.repeat(np.arange(n), [len(v) for v in sizes])
        part_owner, part = part_owner[part > 0], part[part > 0]
        stops = np.cumsum(part)
        self.count, self.pts = count, _Listed(pts, owner, n)
        self.reach = np.zeros(n)
        np.maximum.at(self.reach, owner, np.abs(pts).max(axis=1) if len(pts) else np.zeros(0))
        opens = np.zeros(len(pts), bool)
        opens[stops - part] = True
        joined = ~np.append(opens[1:], True) & (self.dim[owner] > 0) if len(pts) else opens
        at = np.flatnonzero(joined)
        segs = np.concatenate((pts[at], pts[np.minimum(at + 1, max(len(pts) - 1, 0))]), axis=1)
        self.segs = _Listed(np.column_stack((segs, opens[at])), owner[at], n)  # the last column marks segments that begin a part
        solid = np.isin(np.arange(n), owner[at])
        bare = ~solid[owner]
        walls, wall_owner = np.concatenate((segs, np.tile(pts[bare], 2))), np.concatenate((owner[at], owner[bare]))
        order = np.argsort(wall_owner, kind="stable")
        self.walls = _Listed(walls[order], wall_owner[order], n)  # segments, or vertices of shapes without any
        lone = (stops - 1)[(part == 1) | (self.dim[part_owner] == 0)] if len(part) else stops
        lone = np.flatnonzero((self.dim[owner] == 0) | np.isin(np.arange(len(pts)), lone))
        self.lone = _Listed(pts[lone], owner[lone], n)
        lines = self.dim[part_owner] == 1
        tips = np.column_stack((np.repeat(part_owner[lines], 2).astype(float), pts[np.column_stack((stops - part, stops - 1))[lines].ravel()]))
        tips, times = np.unique(tips, axis=0, return_counts=True) if len(tips) else (tips, np.zeros(0, int))
        tips = tips[times % 2 == 1]  # end positions met an odd number of times bound a set of lines
        self.ends = _Listed(tips[:, 1:], tips[:, 0].astype(int), n)
        self.inner = _Listed(*self._inner(pts, owner, stops - part, part_owner), n)

    def _inner(self, pts, owner, first, part_owner):
        """At least one inside position for every connected part of each area."""
        rings = np.flatnonzero(self.dim[part_owner] == 2)
        if not len(rings):
            return np.empty((0, 2)), np.zeros(0, int)
        lows = np.minimum.reduceat(pts[:, 1], first)[rings]
        values, rank = np.unique(pts[:, 1], return_inverse=True)
        keys = np.unique(owner * len(values) + rank)
        above = np.searchsorted(keys, part_owner[rings] * len(values) + np.searchsorted(values, lows), "right")
        tall = np.flatnonzero(above < len(keys))
        tall = tall[keys[above[tall]] // len(values) == part_owner[rings[tall]]]
        ys, mine = (lows[tall] + values[keys[above[tall]] % len(values)]) / 2, part_owner[rings[tall]]
        found = list(_stabbed(ys, mine, self.segs.rows[:, :4], self.segs.owner))
        if not found:
            return np.empty((0, 2)), np.zeros(0, int)
        ring, x = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((x, ring))
        ring, x = ring[order], x[order]
        place = np.arange(len(ring)) - np.searchsorted(ring, ring)
        opening = np.flatnonzero((place[:-1] % 2 == 0) & (ring[1:] == ring[:-1]) & (x[1:] > x[:-1]))
        return np.column_stack(((x[opening] + x[opening + 1]) / 2, ys[ring[opening]])), mine[ring[opening]]


OUT, EDGE, IN = 0, 1, 2  # where a position is


def _place(shapes, chosen, p, pair, eps, begins=None):
    """OUT, EDGE or IN for positions of pairs against the chosen shapes; `begins` marks positions that don't follow the one before on a line cut at each contact."""
    dim, on = shapes.dim[chosen], np.zeros(len(p), bool)
    walls, w_pair = shapes.walls.of(chosen)
    for i, j in _grouped_pairs(_dots(p), pair, _boxes(walls, eps[w_pair]), w_pair):
        on[i[_gaps(p[i], walls[j]) <= eps[pair[i]]]] = True
    out = np.where(on, np.where(dim[pair] == 2, EDGE, IN), OUT)
    ends, e_pair = shapes.ends.of(chosen)
    for i, _ in _grouped_pairs(_dots(p), pair, _dots(ends, eps[e_pair]), e_pair):
        out[i] = EDGE
    if not len(p) or not (dim == 2).any():
        return out
    # Without a contact between them, neighbours on a line are at the same place: one of them is asked.
    change = np.ones(len(p), bool) if begins is None else begins | np.concatenate(([True], (on[1:] != on[:-1]) | (pair[1:] != pair[:-1])))
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(p)) - 1
    asked = np.flatnonzero(~on[first] & (dim[pair[first]] == 2))
    spot = ((first + last) // 2)[asked]
    segs, s_pair = _only(shapes.segs, chosen, dim == 2)
    right = np.zeros(len(spot), np.int64)
    for i, x in _stabbed(p[spot, 1], pair[spot], segs[:, :4], s_pair):
        right += np.bincount(i[p[spot[i], 0] < x], minlength=len(spot))
    within = np.zeros(len(first), bool)
    within[asked] = right % 2 == 1
    out[np.repeat(within, last - first + 1)] = IN
    return out


def _only(listed, chosen, which):
    """The rows of some of the chosen owners, by their index in `chosen`."""
    kept = np.flatnonzero(which)
    rows, pair = listed.of(chosen[kept])
    return rows, kept[pair]


def _cut(shapes, mine, other, eps):
    """(positions along the lines of `mine` cut at each contact with `other`, their pairs, whether inside a piece, whether a part begins there)."""
    segs, s_pair = shapes.segs.of(mine)
    opens, segs = segs[:, 4] > 0, segs[:, :4]
    theirs, t_pair = shapes.segs.of(other)
    pts, p_pair = shapes.pts.of(other)
    x, y, dx, dy = _ways(segs)
    length, every = np.hypot(dx, dy), np.arange(len(segs))
    of, at, wide = [every, every], [np.zeros(len(every)), np.ones(len(every))], _boxes(segs, eps[s_pair])
    with np.errstate(divide="ignore", invalid="ignore"):
        for i, j in _grouped_pairs(wide, s_pair, _dots(pts), p_pair):
            ox, oy = pts[j].T
            t = ((ox - x[i]) * dx[i] + (oy - y[i]) * dy[i]) / length[i] ** 2
            touch = (np.abs((ox - x[i]) * dy[i] - (oy - y[i]) * dx[i]) / length[i] <= eps[s_pair[i]]) & (t > 0) & (t < 1)
            of.append(i[touch])
            at.append(t[touch])
        for i, j in _grouped_pairs(wide, s_pair, _boxes(theirs[:, :4]), t_pair):
            ox, oy, ex, ey = _ways(theirs[j, :4])
            den = dx[i] * ey - dy[i] * ex
            s = ((ox - x[i]) * ey - (oy - y[i]) * ex) / den
            u = ((ox - x[i]) * dy[i] - (oy - y[i]) * dx[i]) / den
            meet = (den != 0) & (s > 0) & (s < 1) & (u >= 0) & (u <= 1)
            of.append(i[meet])
            at.append(s[meet])
    of, at = np.concatenate(of), np.concatenate(at)
    order = np.lexsort((at, of))
    of, at = of[order], at[order]
    spot = lambda k, t: np.column_stack((x[k] + dx[k] * t, y[k] + dy[k] * t))
    pieces = np.flatnonzero((of[1:] == of[:-1]) & ((at[1:] - at[:-1]) * length[of[1:]] > 2 * eps[s_pair[of[1:]]]))
    nodes, mids = spot(of, at), spot(of[pieces], (at[pieces] + at[pieces + 1]) / 2)
    row = np.argsort(np.concatenate((2 * np.arange(len(of)), 2 * pieces + 1)), kind="stable")
    begins = opens[of] & np.concatenate(([True], of[1:] != of[:-1]))[:len(of)]
    middle = np.repeat([False, True], (len(of), len(pieces)))
    return np.concatenate((nodes, mids))[row], s_pair[np.concatenate((of, of[pieces]))][row], middle[row], np.concatenate((begins, np.zeros(len(pieces), bool)))[row]


def _samples(shapes, mine, other, eps):
    """Bits 3 * part of `mine` + place in `other` that occur in each pair, and those of whole pieces alone."""
    dim, bits, whole = shapes.dim[mine], np.zeros(len(mine), int), np.zeros(len(mine), int)
    spots, pair, middle, begins = _cut(shapes, mine, other, eps)
    places = _place(shapes, other, spots, pair, eps, begins)
    alone, a_pair = shapes.lone.of(mine)
    nodes, n_pair = np.concatenate((spots[~middle], alone)), np.concatenate((pair[~middle], a_pair))
    at_nodes = np.concatenate((places[~middle], _place(shapes, other, alone, a_pair, eps)))
    order = np.argsort(n_pair, kind="stable")
    nodes, n_pair, at_nodes = nodes[order], n_pair[order], at_nodes[order]
    part = np.where(dim[n_pair] == 2, EDGE, IN)
    ends, e_pair = shapes.ends.of(mine)
    for i, _ in _grouped_pairs(_dots(nodes), n_pair, _dots(ends, eps[e_pair]), e_pair):
        part[i] = EDGE
    np.bitwise_or.at(bits, n_pair, 1 << (3 * part + at_nodes))
    np.bitwise_or.at(whole, pair[middle], 1 << (3 * np.where(dim[pair[middle]] == 2, EDGE, IN) + places[middle]))
    return bits | whole, whole


def _relate(shapes, a, b):
    """Bits of the predicates that hold for the shapes a and b of each pair."""
    bit = lambda part, place: 1 << (3 * part + place)
    has = lambda bits, *pairs: (bits & sum(bit(*p) for p in pairs)) != 0
    da, db = shapes.dim[a], shapes.dim[b]
    eps = 1e-9 * np.maximum(1.0, np.maximum(shapes.reach[a], shapes.reach[b])) / 1e2
    m, a_whole = _samples(shapes, a, b, eps)
    turned, b_whole = _samples(shapes, b, a, eps)
    for x in (OUT, EDGE, IN):
        for y in (OUT, EDGE, IN):
            m |= np.where(turned & bit(x, y), bit(y, x), 0)
    m |= np.where((da == 2) & (db < 2), bit(IN, OUT), 0) | np.where((db == 2) & (da < 2), bit(OUT, IN), 0)
    areas = (da == 2) & (db == 2)
    into, back = areas & has(a_whole, (EDGE, IN)), areas & has(b_whole, (EDGE, IN))
    m |= np.where(into, bit(IN, IN) | bit(OUT, IN), 0) | np.where(back, bit(IN, IN) | bit(IN, OUT), 0)
    m |= np.where(areas & has(a_whole, (EDGE, OUT)), bit(IN, OUT), 0) | np.where(areas & has(b_whole, (EDGE, OUT)), bit(OUT, IN), 0)
    open_ = areas & ~into & ~back
    for mine, other, swap in ((a, b, False), (b, a, True)):
        inner, pair = _only(shapes.inner, mine, open_)
        places = _place(shapes, other, inner, pair, eps)
        sure = places != EDGE
        np.bitwise_or.at(m, pair[sure], np.where(swap, 1 << (3 * places + IN), 1 << (3 * IN + places))[sure])
    meet, inside, long = has(m, (IN, IN), (IN, EDGE), (EDGE, IN), (EDGE, EDGE)), has(m, (IN, IN)), has(a_whole, (IN, IN))
    holds = {
        "intersects": meet, "disjoint": ~meet,
        "contains": inside & ~has(m, (OUT, IN), (OUT, EDGE)),
        "within": inside & ~has(m, (IN, OUT), (EDGE, OUT)),
        "equals": (da == db) & inside & ~has(m, (IN, OUT), (EDGE, OUT), (OUT, IN), (OUT, EDGE)),
        "touches": meet & ~inside,
        "crosses": inside & (((da < db) & has(m, (IN, OUT))) | ((da > db) & has(m, (OUT, IN))) | ((da == 1) & (db == 1) & ~long)),
        "overlaps": inside & (da == db) & has(m, (IN, OUT)) & has(m, (OUT, IN)) & ((da != 1) | long),
    }
    out = sum(np.where(holds[name], 1 << i, 0) for i, name in enumerate(PREDICATES))
    return np.where((shapes.count[a] == 0) | (shapes.count[b] == 0), 1 << PREDICATES.index("disjoint"), out)


def _least_gap(p, segs):
    """The smallest distance from positions to segments: blocks of neighbours, the closest boxes first, until no box is closer than what was found."""
    step_p, step_s = (max(64, int(np.sqrt(len(x)))) for x in (p, segs))
    at_p, at_s = np.arange(0, len(p), step_p), np.arange(0, len(segs), step_s)
    boxes = _boxes(segs)
    lo_p, hi_p = np.minimum.reduceat(p, at_p), np.maximum.reduceat(p, at_p)
    lo_s, hi_s = np.minimum.reduceat(boxes[:, :2], at_s), np.maximum.reduceat(boxes[:, 2:], at_s)
    apart = np.maximum(0.0, np.maximum(lo_p[:, None] - hi_s[None], lo_s[None] - hi_p[:, None]))
    bound, least = np.hypot(apart[..., 0], apart[..., 1]), np.inf
    for k in np.argsort(bound, axis=None):
        i, j = divmod(int(k), len(at_s))
        if bound[i, j] >= least:
            break
        least = min(least, _gaps(p[at_p[i]:at_p[i] + step_p, None], segs[at_s[j]:at_s[j] + step_s]).min())
    return float(least)


def _Shape(dim, xs, ys, sizes):
    """One geometry alone."""
    return Shapes([dim], [xs], [ys], [sizes])


def _gap(p, shape):
    """Distances from positions to each segment (vertex of point sets) of one geometry, as a table."""
    return _gaps(p[:, None], shape.walls.rows)


def _separation(shapes, a, b):
    """Smallest distances of the pairs, 0 where they meet, NaN where one is empty."""
    out = np.where(_relate(shapes, a, b) & 1, 0.0, np.inf)
    out[(shapes.count[a] == 0) | (shapes.count[b] == 0)] = np.nan
    apart = np.flatnonzero(np.isinf(out))
    walls = np.diff(shapes.walls.starts)
    for one, other in ((a, b), (b, a)):
        small = shapes.count[one[apart]] * walls[other[apart]] <= 1 << 14
        pts, pair = _only(shapes.pts, one, np.isin(np.arange(len(out)), apart[small]))
        for at in range(0, len(pts), 1 << 14):
            p, own = pts[at:at + (1 << 14)], pair[at:at + (1 << 14)]
            x, y = _expanded(shapes.walls.starts[other[own]], walls[other[own]])
            np.minimum.at(out, own[x], _gaps(p[x], shapes.walls.rows[y]))
        for k in apart[~small]:
            choice = np.array([k])
            out[k] = min(out[k], _least_gap(shapes.pts.of(one[choice])[0], shapes.walls.of(other[choice])[0]))
    return out


VERTICES_AT_ONCE = 200_000  # vertices of the pairs related together, which bounds memory; a pair of larger shapes goes alone


def _tested(test, shapes, full):
    """test(shapes, a, b) of the pairs of shapes in the rows of `full`, each pair of shapes once."""
    pairs, which = np.unique(full, axis=0, return_inverse=True)
    ends, found, at = np.cumsum(shapes.count[pairs].sum(axis=1)), [], 0
    while at < len(pairs):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + VERTICES_AT_ONCE)))
        found.append(test(shapes, pairs[at:stop, 0], pairs[at:stop, 1]))
        at = stop
    return np.concatenate(found)[which.ravel()] if found else np.zeros(0)


def each_pair(test, pairs):
    """test(shapes, a, b) of pairs of (dimension, xs, ys, part sizes), None where one is null; each shape is built once."""
    known, indexes = {}, []
    for pair in pairs:
        if any(v is None for part in pair for v in part[:2]):
            indexes.append(None)
            continue
        keys = [tuple(np.asarray(v).tobytes() for v in part) for part in pair]
        indexes.append([known.setdefault(k, (len(known), part))[0] for k, part in zip(keys, pair)])
    shapes = Shapes(*([part[k] for _, part in known.values()] for k in range(4)))
    full = np.array([k for k in indexes if k is not None], int).reshape(-1, 2)
    values = iter(_tested(test, shapes, full).tolist())
    return [None if k is None else next(values) for k in indexes]


def _slices(lists, kind):
    """The items of lists as one array, and where each list begins and ends."""
    items = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).astype(int)
    return items, np.concatenate(([0], ends))


def _over_pairs(test, kind):
    out = pa.int32() if kind == "int" else pa.float64()

    def run(da: pa.Array, xa: pa.Array, ya: pa.Array, na: pa.Array,
            db: pa.Array, xb: pa.Array, yb: pa.Array, nb: pa.Array) -> pa.Array:
        absent = np.any([v.is_null().to_numpy(zero_copy_only=False) for v in (da, xa, db, xb)], axis=0)
        full, known = np.zeros((len(da), 2), int), {}
        for side, (d, *lists) in enumerate(((da, xa, ya, na), (db, xb, yb, nb))):
            dims = pc.fill_null(d, 0).to_numpy(zero_copy_only=False).astype(int)
            (x, at), (y, _), (n, n_at) = (_slices(v, t) for v, t in zip(lists, (float, float, int)))
            for k in np.flatnonzero(~absent):
                p, q, r, t = at[k], at[k + 1], n_at[k], n_at[k + 1]
                key = (dims[k], x[p:q].tobytes(), y[p:q].tobytes(), n[r:t].tobytes())
                if key not in known:
                    known[key] = len(known), (dims[k], x[p:q], y[p:q], n[r:t])
                full[k, side] = known[key][0]
        shapes = Shapes(*([part[k] for _, part in known.values()] for k in range(4)))
        found = np.zeros(len(full))
        found[~absent] = _tested(test, shapes, full[~absent])
        return pa.array(found, mask=absent | np.isnan(found)).cast(out)
    # Not declared deterministic, so that it is neither repeated nor moved below a repartition.
    return F.arrow_udf(run, kind).asNondeterministic()


_relate_udf = None
_separation_udf = None


def flat(geom: Column) -> list[Column]:
    """Dimension, xs, ys and ring sizes: plain arrays that Arrow hands over without copying rows."""
    v = g.vertices(geom)
    return [g.dimension(geom), F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"]),
            F.transform(F.flatten(geom["parts"]), lambda r: F.size(r))]


def relation(a: Column, b: Column) -> Column:
    """Bit set of the predicates that hold, in the order of `PREDICATES`."""
    global _relate_udf
    _relate_udf = _relate_udf or _over_pairs(_relate, "int")
    return _relate_udf(*flat(a), *flat(b))


def holds(predicate: str, a: Column, b: Column) -> Column:
    return relation(a, b).bitwiseAND(F.lit(1 << PREDICATES.index(predicate))) != 0


def distance(a: Column, b: Column) -> Column:
    """Smallest distance between two geometries, 0 where they meet."""
    global _separation_udf
    _separation_udf = _separation_udf or _over_pairs(_separation, "double")
    return _separation_udf(*flat(a), *flat(b))


def is_within_distance(a: Column, b: Column, limit) -> Column:
    return distance(a, b) <= limit
