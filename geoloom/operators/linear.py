"""Linear referencing on measured lines: (id, geom, from_measure, to_measure)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geometry as g


def measured_segments(lines: DataFrame) -> DataFrame:
    """One row per segment, with the measures at its ends.

    The running length is taken over one line's own vertices, which fit in a row.
    """
    along = Window.partitionBy("id").orderBy("pos")
    rest = [c for c in lines.columns if c not in ("geom",)]
    segs = (lines.filter(g.geom_length(F.col("geom")) > 0)
            .select(*rest, F.posexplode(g.segments(g.vertices(F.col("geom")))).alias("pos", "s"))
            .withColumn("_len", F.hypot(F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y"))))
    segs = segs.withColumn("_upto", F.sum("_len").over(along)).withColumn(
        "_total", F.sum("_len").over(Window.partitionBy("id")))
    scale = (F.col("to_measure") - F.col("from_measure")) / F.col("_total")
    return segs.select(
        *rest, "pos", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"),
        F.col("s.b.y").alias("y2"), (F.col("from_measure") + (F.col("_upto") - F.col("_len")) * scale).alias("m1"),
        (F.col("from_measure") + F.col("_upto") * scale).alias("m2"))


def _between(m: Column, axis: str) -> Column:
    share = (m - F.col("m1")) / F.nullif(F.col("m2") - F.col("m1"), F.lit(0.0))
    return F.col(f"{axis}1") + F.coalesce(share, F.lit(0.0)) * (F.col(f"{axis}2") - F.col(f"{axis}1"))


def geocode(lines: DataFrame, measure: Column) -> DataFrame:
    """Position (x, y) on each line at a measure within its range."""
    here = measured_segments(lines).withColumn("measure", measure).filter(
        F.col("measure").between(F.col("m1"), F.col("m2")))
    at = here.groupBy("id", "measure").agg(F.min_by(
        F.struct(_between(F.col("measure"), "x").alias("x"), _between(F.col("measure"), "y").alias("y")), "pos").alias("p"))
    return at.select("id", "measure", "p.x", "p.y")


def measure_at(lines: DataFrame, x: Column, y: Column) -> DataFrame:
    """Measure on each line of the position nearest to (x, y), and how far away that is."""
    segs = measured_segments(lines).withColumns({"_px": x, "_py": y})
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    share = F.least(F.greatest(F.coalesce(((F.col("_px") - F.col("x1")) * dx + (F.col("_py") - F.col("y1")) * dy)
                                          / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    near = segs.withColumn("_t", share).withColumn("distance", F.hypot(
        F.col("x1") + F.col("_t") * dx - F.col("_px"), F.col("y1") + F.col("_t") * dy - F.col("_py")))
    best = near.groupBy("id").agg(F.min_by(F.struct(
        (F.col("m1") + F.col("_t") * (F.col("m2") - F.col("m1"))).alias("measure"), "distance"),
        F.struct("distance", "pos")).alias("b"))
    return best.select("id", "b.measure", "b.distance")


def segment_between(lines: DataFrame, begin: Column, end: Column) -> DataFrame:
    """The piece of each line between two measures, as a line."""
    segs = measured_segments(lines).withColumns({"_b": begin, "_e": end}).filter(
        (F.col("m2") > F.col("_b")) & (F.col("m1") < F.col("_e")))
    first, last = F.greatest("m1", "_b"), F.least("m2", "_e")
    cut = segs.select("id", "pos", g.vertex(_between(first, "x"), _between(first, "y")).alias("a"),
                      g.vertex(_between(last, "x"), _between(last, "y")).alias("b"))
    whole = cut.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b"))).alias("s"))
    track = F.concat(F.transform("s", lambda r: r["a"]), F.array(F.element_at("s", -1)["b"]))
    return whole.select("id", g.line(track).alias("geom"))
