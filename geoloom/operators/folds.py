"""Per-key folds that combine on the map side, and id numbering without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: list[str], order: list[Column], newest: bool = False) -> DataFrame:
    """One row per key: the first (or last) in the given order. Nulls order first."""
    rest = [c for c in df.columns if c not in keys]
    chosen = (F.max_by if newest else F.min_by)(F.struct(*rest), F.struct(*order))
    out = df.groupBy(*keys).agg(chosen.alias("_row"))
    return out.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def latest(events: DataFrame, key: str = "id", order: str = "event_no") -> DataFrame:
    """Current rows of an event table: the newest event per key."""
    return pick(events, [key], [F.col(order)], newest=True)


def exactly_one(df: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """One row per key with its `matches` count; with `strict`, any other count is an error."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"),
                                F.min(F.struct(*rest)).alias("_row"))
    if strict:
        message = F.concat(F.lit("expected exactly one row for "), F.concat_ws(",", *keys))
        out = out.withColumn("matches", F.when(F.col("matches") == 1, F.col("matches"))
                             .otherwise(F.raise_error(message).cast("bigint")))
    return out.select(*keys, "matches", *[F.col("_row")[c].alias(c) for c in rest])


def assign_ids(df: DataFrame, key: str, start: DataFrame | int = 0, name: str = "id") -> DataFrame:
    """Number rows 1, 2, … after `start`, in the order of md5(key), then key.

    `key` must be unique, which makes the numbering the same on every retry. The hash prefix
    splits the rows evenly, so each part is numbered on its own and only the 4096 part sizes are
    added up in one place. `start` is a number or a table whose `id` column holds ids in use.
    """
    hashed = df.withColumn("_h", F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    part = F.substring("_h", 1, 3)
    sizes = hashed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_h", key))
    if isinstance(start, DataFrame):
        first = F.coalesce(start.agg(F.max("id")).scalar(), F.lit(0))
    else:
        first = F.lit(start)
    return (hashed.withColumn("_part", part)
            .join(F.broadcast(offsets), "_part")  # at most 4096 rows
            .withColumn(name, (first + F.col("_before") + within).cast("bigint"))
            .drop("_part", "_h", "_before"))
