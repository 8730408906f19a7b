"""Class breaks of a numeric column, and assignment of values to classes.

Each method gives a one-row table with `breaks`, an ascending array from the lowest to the highest
value; n classes have n + 1 breaks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.ordering import exact_quantiles, value_ranks

BARS = 1024


def equal_interval(df: DataFrame, value: str, n: int) -> DataFrame:
    low, high = F.min(value).cast("double"), F.max(value).cast("double")
    return df.agg(F.array(*[low + (high - low) * F.lit(i / n) for i in range(n)], high).alias("breaks"))


def _from_quantiles(quantiles: DataFrame) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("prob", "quantile")))  # n + 1 rows
    return quantiles.agg(F.transform(rows, lambda r: r["quantile"]).alias("breaks"))


def quantile(df: DataFrame, value: str, n: int) -> DataFrame:
    return _from_quantiles(exact_quantiles(df, value, [i / n for i in range(n + 1)]))


def unique_interval(df: DataFrame, value: str, n: int) -> DataFrame:
    """Each class gets about as many distinct values."""
    return _from_quantiles(exact_quantiles(df, value, [i / n for i in range(n + 1)], distinct=True))


def standard_deviation(df: DataFrame, value: str, n: int) -> DataFrame:
    """Inner breaks one standard deviation apart, centred on the mean."""
    mean, dev = F.avg(value), F.stddev_pop(value)
    inner = [mean - dev * F.lit(n / 2 - i) for i in range(1, n)]
    return df.agg(F.array(F.min(value).cast("double"), *inner, F.max(value).cast("double")).alias("breaks"))


def jenks(df: DataFrame, value: str, n: int, bars: int = BARS) -> DataFrame:
    """Natural breaks: the classes with the least squared deviation from their means.

    All rows are first counted into runs of neighbouring values: `bars` of about equally many distinct values, cut besides at
    the edges of as many ranges of equal width, so that neither crowds nor outliers share a run with the rest. With at most
    `bars` distinct values each has a run of its own and the breaks are exact. Only the runs are searched. There are n classes
    wherever there are n distinct values; NaN is left out.
    """
    v = F.col(value).cast("double")
    rows = df.select(v.alias("_value")).filter(v.isNotNull() & ~F.isnan(v))
    ranks = value_ranks(rows, "_value").crossJoin(F.broadcast(rows.agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"))))  # one row
    share = (F.col("_v") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    spot = F.struct(F.floor(F.col("_rank") * F.least(F.lit(max(n, bars)), "_total") / F.col("_total")), F.floor(F.coalesce(share, F.lit(0.0)) * bars))
    bars = ranks.groupBy(spot.alias("spot")).agg(
        F.sum("_n").cast("double").alias("n"), F.sum(F.col("_v") * F.col("_n")).alias("s"), F.sum(F.col("_v") * F.col("_v") * F.col("_n")).alias("q"),
        F.min("_v").alias("low"), F.max("_v").alias("high"))

    def search(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("low")
        return pd.DataFrame({"breaks": [natural_breaks(bars, n)]})

    return bars.groupBy().applyInPandas(search, "breaks array<double>")


def natural_breaks(bars: pd.DataFrame, n: int) -> list[float]:
    """Best split of ordered histogram bars into n runs, by dynamic programming."""
    m = len(bars)
    n = min(n, m)
    sums = {c: np.concatenate([[0.0], np.cumsum(bars[c].to_numpy(float))]) for c in ("n", "s", "q")}

    def spread(i: np.ndarray, j: int) -> np.ndarray:  # bars i … j - 1
        count, total = sums["n"][j] - sums["n"][i], sums["s"][j] - sums["s"][i]
        return (sums["q"][j] - sums["q"][i]) - total * total / count

    best = np.full((n + 1, m + 1), np.inf)
    cut = np.zeros((n + 1, m + 1), int)
    best[0, 0] = 0.0
    for k in range(1, n + 1):
        for j in range(k, m + 1):
            starts = np.arange(k - 1, j)
            cost = best[k - 1, starts] + spread(starts, j)
            at = int(np.argmin(cost))
            best[k, j], cut[k, j] = cost[at], starts[at]
    highs, out, j = bars["high"].to_numpy(float), [], m
    for k in range(n, 0, -1):
        out.append(highs[j - 1])
        j = cut[k, j]
    return [float(bars["low"].iloc[0]), *[float(x) for x in reversed(out)]]


def class_of(value: Column, breaks: Column, upper_closed: bool = False) -> Column:
    """Class number from 0. A value on an inner break goes up, or down with `upper_closed`."""
    inner = F.slice(breaks, 2, F.greatest(F.size(breaks) - 2, F.lit(0)))
    below = F.filter(inner, lambda b: b < value if upper_closed else b <= value)
    return F.when(value.isNotNull(), F.size(below))


def classify(df: DataFrame, value: str, breaks: DataFrame, upper_closed: bool = False) -> DataFrame:
    """Adds `class` from a one-row table of breaks."""
    with_breaks = df.withColumn("_breaks", breaks.select("breaks").scalar())
    return with_breaks.withColumn("class", class_of(F.col(value), F.col("_breaks"), upper_closed)).drop("_breaks")
