"""Equi-join that spreads hot keys, and columns that are computed once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot from this share of a side's rows on, so there are at most twice as many hot keys as the share goes into
# one: that bounds what is broadcast whatever the data.
HOT_SHARE = 1e-5


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys come from `left`."""
    own = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [left[k].eqNullSafe(own[f"_right_{k}"]) for k in keys]
    return left.join(own, reduce(lambda a, b: a & b, same), how).drop(*[f"_right_{k}" for k in keys])


def _hot(side: DataFrame, keys: list[str], hot_rows: int, cuts: str) -> DataFrame:
    sizes = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    least = F.greatest(F.lit(hot_rows), F.ceil(F.coalesce(sizes.agg(F.sum("_n")).scalar(), F.lit(0)) * HOT_SHARE))
    return sizes.filter(F.col("_n") > least).select(*keys, F.ceil(F.col("_n") / least).cast("int").alias(cuts))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str,
                hot_rows: int = 200_000, right_spread: str | None = None) -> DataFrame:
    """Inner join on `keys` where a side may hold very many rows of one key.

    A side's keys with more than `hot_rows` rows, and more than HOT_SHARE of all, are cut into several by a hash of
    `spread` (`right_spread` on the right, which is left whole without it); the other side's rows are repeated once per cut.
    All other keys join as they are.
    """
    hot = _hot(left, keys, hot_rows, "_lcuts")
    if right_spread:
        hot = hot.join(_hot(right, keys, hot_rows, "_rcuts"), keys, "full")
    else:
        hot = hot.withColumn("_rcuts", F.lit(1))
    hot = F.broadcast(hot)
    lcuts, rcuts = (F.coalesce(c, F.lit(1)) for c in ("_lcuts", "_rcuts"))
    share = lambda by, cuts: F.pmod(F.xxhash64(by), cuts).cast("int")
    every = lambda cuts: F.explode(F.sequence(F.lit(0), cuts - 1))
    cut_left = left.join(hot, keys, "left").withColumn("_lsalt", share(spread, lcuts)).withColumn("_rsalt", every(rcuts))
    cut_right = right.join(hot, keys, "left").withColumn("_lsalt", every(lcuts)).withColumn(
        "_rsalt", share(right_spread, rcuts) if right_spread else F.lit(0))
    cut_left, cut_right = (side.drop("_lcuts", "_rcuts") for side in (cut_left, cut_right))
    return cut_left.join(cut_right, [*keys, "_lsalt", "_rsalt"]).drop("_lsalt", "_rsalt")


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns so that filters on them are not pushed below and worked out again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
