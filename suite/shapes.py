"""Geometries derived from the sample tables, and the SQL that derives the same vertices."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.operators.skew import computed_once

# Lines of three to six vertices on quarter degrees, one per order, with a range of measures.
VX = "cast(id*37%1360 as double)/4-170+{i}*0.75"
VY = "cast(id*53%640 as double)/4-80+cast(id*({i}+1)*7%5 as double)*0.25"
LINE_SQL = "(select o_orderkey as id, cast(3+o_orderkey%4 as int) as n, cast(o_orderkey%10 as double) as m0, cast(o_orderkey%10+20 as double) as m1 from orders)"
VERTEX_SQL = f"(select l.id, l.n, l.m0, l.m1, v.i, {VX.format(i='v.i')} as x, {VY.format(i='v.i')} as y from {LINE_SQL} l, (select unnest(range(6)) as i) v where v.i < l.n)"
SEGMENT_SQL = f"(select a.id, a.n, a.m0, a.m1, a.i, a.x as x1, a.y as y1, b.x as x2, b.y as y2, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) as len from {VERTEX_SQL} a join {VERTEX_SQL} b on a.id = b.id and b.i = a.i + 1)"


def lines(t):
    rows = t.sql("""select o_orderkey as id, cast(3+o_orderkey%4 as int) as n, cast(o_orderkey%10 as double) as from_measure,
        cast(o_orderkey%10+20 as double) as to_measure from {orders}""")
    vertices = F.expr("transform(sequence(0, n-1), i -> named_struct('x', " + VX.format(i="i") + ", 'y', " + VY.format(i="i") + "))")
    return computed_once(rows, geom=g.line(vertices)).drop("n")


def _diamond(r):
    return F.array(*[g.vertex(F.col("cx") + dx * r, F.col("cy") + dy * r)
                     for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))])


def zones(t):
    """Diamonds with a diamond hole of half the size."""
    r = F.col("r")
    return computed_once(t("f_zones"), geom=g.polygon(_diamond(r), _diamond(r / 2))).select("id", "locator", "geom")


def solid_zones(t):
    return computed_once(t("f_zones"), geom=g.polygon(_diamond(F.col("r")))).select("id", "locator", "geom")


def boxes(t):
    return t("f_geometadata").select("id", "minx", "maxx", "miny", "maxy")
