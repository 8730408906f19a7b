"""Exact quantiles of whole tables and of hot groups, without sorting a group in one task."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.skew import null_safe_join

RANGE_ROWS = 1_000_000  # rows that a range is aimed at: what one task orders


def binned(df: DataFrame, value: str, bins: int | None = None) -> DataFrame:
    """Adds `_bin`, ranges of about equal row counts; NaN is in the last. Where they lie affects speed only.

    There are `bins` ranges, by default one for every RANGE_ROWS rows and 64 at least. Rows are counted and boundaries estimated
    by jobs that run at once.
    """
    bins = bins or max(64, df.count() // RANGE_ROWS + 1)
    cuts = sorted({v for v in df.approxQuantile(value, [i / bins for i in range(1, bins)], 0.25 / bins)
                   if v is not None and math.isfinite(v)}) if bins > 1 else []
    if not cuts:
        return df.withColumn("_bin", F.lit(0.0))
    return Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=value, outputCol="_bin", handleInvalid="keep").transform(df)


def value_counts(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return (df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
            .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")))


def exact_quantiles(df: DataFrame, value: str, probs: list[float], keys: list[str] | None = None,
                    bins: int | None = None, distinct: bool = False) -> DataFrame:
    """(keys, prob, quantile) with linear interpolation between neighbours. A null key is a key; NaN is the largest value.

    Values are counted, then put in ranges; the few ranges that hold a wanted rank are found from
    their sizes, and only those are ordered. With `distinct`, each value counts once.
    """
    keys = keys or []
    counts = value_counts(df, value, keys)
    if distinct:
        counts = counts.withColumn("_n", F.lit(1).cast("bigint"))
    counts = binned(counts, "_v", bins)
    sizes = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_size"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.sum("_size").over(over.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*keys, "_bin", "_size", F.coalesce(before, F.lit(0)).alias("_before"),
                         F.sum("_size").over(over).alias("_total"))
    wanted = (sizes.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
              .withColumn("_pos", F.col("prob") * (F.col("_total") - 1))
              .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
              .filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_size"))))
    spots = wanted.select(*keys, "_bin", "_before").distinct()
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy("_v"))
    ranked = null_safe_join(counts, spots, [*keys, "_bin"]).select(
        *keys, "_bin", "_v", "_n", (F.col("_before") + upto).alias("_upto"))
    picked = null_safe_join(ranked, wanted.select(*keys, "_bin", "prob", "_pos", "_rank"), [*keys, "_bin"]).filter(
        (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
    low, high = F.min("_v"), F.max("_v")
    share = F.max("_pos") - F.floor(F.max("_pos"))
    return picked.groupBy(*keys, "prob").agg((low + (high - low) * share).alias("quantile"))


def median(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    return exact_quantiles(df, value, [0.5], keys).drop("prob").withColumnRenamed("quantile", "median")


def value_ranks(df: DataFrame, value: str, bins: int | None = None) -> DataFrame:
    """Distinct values `_v` with their counts `_n`, ranks `_rank` from 0 and how many there are, `_total`."""
    counts = binned(value_counts(df, value, []), "_v", bins)
    sizes = counts.groupBy("_bin").agg(F.count(F.lit(1)).alias("_size"))  # one row a range
    before = F.sum("_size").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_bin", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(F.lit(0))).alias("_total"))
    within = F.row_number().over(Window.partitionBy("_bin").orderBy("_v")) - 1
    return counts.withColumn("_within", within).join(sizes, "_bin").select("_v", "_n", (F.col("_before") + F.col("_within")).alias("_rank"), "_total")
