"""File bodies addressed by locator."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.inspection import MAX_BLOB


def path_below(path: Column, prefix: str) -> Column:
    """The part of a file path that follows a folder."""
    root = re.escape("/" + prefix.split("://")[-1].strip("/") + "/")
    return F.regexp_extract(F.regexp_replace(path, "^[a-z]+:/*", "/"), f"^(?:.*?){root}(.*)$", 1)


def scan_blobs(spark: SparkSession, prefix: str, locators: DataFrame | None = None,
               stream: bool = False, longest: int = MAX_BLOB) -> DataFrame:
    """(locator, length, content) of the files under a prefix; a locator is the path below it.

    Bodies too long for one value are listed without content, and without being read. With `locators`, one row each, and
    `found` false where there is no such file (the source skips empty files).
    """
    reader = (spark.readStream if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true")
    # The filters on length reach the source, and where content isn't asked for no body is opened.
    files = reader.load(prefix)
    locator = path_below(F.col("path"), prefix).alias("locator")
    rows = files.filter(F.col("length") <= longest).select(locator, "length", "content").unionByName(
        files.filter(F.col("length") > longest).select(locator, "length", F.lit(None).cast("binary").alias("content")))
    if locators is None:
        return rows
    return locators.select("locator").distinct().join(rows, "locator", "left").withColumn(
        "found", F.col("length").isNotNull())


def land_blobs(files: DataFrame, root: str, batch: int) -> DataFrame:
    """Store bodies (name, content) and return their announcements (name, locator).

    A locator is the hash of the body, so equal files share one, and a retry changes nothing.
    """
    landed = files.withColumn("locator", F.sha2("content", 256))
    (landed.select("locator", F.length("content").cast("bigint").alias("length"), "content")
     .dropDuplicates(["locator"]).write.mode("overwrite").parquet(f"{root}/batch={batch}"))
    return landed.select("name", "locator")


def read_landed(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).select("locator", "length", "content").dropDuplicates(["locator"])
