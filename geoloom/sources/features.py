"""Feature tables of all datasets in one place: data files by load, and a small log of loads.

Loading a dataset again, or dropping it, adds a log row; readers take the newest load of each
dataset. Nothing is rewritten in place, and old loads can be deleted when they are no longer read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.operators.spatial import with_box

LOG = "locator string, action string, load bigint"


def _log(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(f"{root}/log")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def _note(locators: DataFrame, action: str, root: str, load: int) -> None:
    rows = locators.select("locator").distinct().select("locator", F.lit(action).alias("action"))
    rows.write.mode("overwrite").parquet(f"{root}/log/load={load}")


def load_features(features: DataFrame, root: str, load: int) -> None:
    """Store features (locator, id, geom, …) as load number `load`, geometries as multi kinds.

    A load replaces the earlier features of its datasets. Files are cut by ranges of locator and
    id: a large dataset gets many files, small ones share, and box statistics let scans skip.
    """
    rows = with_box(features.withColumn("geom", g.promote(F.col("geom"))))
    ordered = rows.repartitionByRange("locator", "id").sortWithinPartitions("locator", "minx", "miny")
    ordered.write.mode("overwrite").parquet(f"{root}/data/load={load}")
    _note(features, "load", root, load)


def drop_features(locators: DataFrame, root: str, load: int) -> None:
    """Forget the features of datasets; unknown ones are no error."""
    _note(locators, "drop", root, load)


def without_features(features: DataFrame, locators: DataFrame) -> DataFrame:
    """The same as a plain snapshot: all features but those of the given datasets."""
    return features.join(locators.select("locator"), "locator", "left_anti")


def read_features(spark: SparkSession, root: str, locators: DataFrame | list[str] | None = None) -> DataFrame:
    """Current features of all datasets, or of the given ones, with their box columns."""
    newest = _log(spark, root).groupBy("locator").agg(F.max_by(F.struct("action", "load"), "load").alias("n"))
    current = newest.filter(F.col("n.action") == "load").select("locator", "n.load")
    rows = spark.read.option("mergeSchema", "true").parquet(f"{root}/data")
    if isinstance(locators, list):
        rows = rows.filter(F.col("locator").isin(*locators))
    elif locators is not None:
        current = current.join(locators.select("locator"), "locator", "left_semi")
    return rows.join(current, ["locator", "load"], "left_semi").drop("load")


def write_features(features: DataFrame, name: str, root: str, load: int) -> DataFrame:
    """Store result features and return the announcement rows of their datasets."""
    load_features(features, root, load)
    return features.select("locator").distinct().select(F.lit(name).alias("name"), "locator")
