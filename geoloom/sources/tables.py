"""Catalogue tables: scans, and appends that a retried batch does not repeat."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions.codecs import bytes_to_hex
from geoloom.functions.bounds import make_bounds
from geoloom.operators.folds import assign_ids
from geoloom.schemas import (
    DEPLOYMENTS_TABLE, GEOMETADATA_TABLE, LEASES_TABLE, METADATA_TABLE, SERVERS_TABLE)

_EVENT = [T.StructField("event_no", T.LongType())]
TABLES = {
    "metadata": METADATA_TABLE, "geometadata": GEOMETADATA_TABLE, "servers": SERVERS_TABLE,
    "deployments": T.StructType(DEPLOYMENTS_TABLE.fields + _EVENT),
    "leases": T.StructType(LEASES_TABLE.fields + _EVENT),
}


def read_catalog(spark: SparkSession, table: str, root: str | None = None, stage: str = "load",
                 before: int | None = None, jdbc: dict | None = None) -> DataFrame:
    """A catalogue table from Parquet, or from a database with `jdbc` options.

    Every writing stage numbers its own batches. `before` leaves out a batch of `stage` and its
    later ones, which a retried batch has to do.
    """
    if jdbc is not None:
        return spark.read.format("jdbc").options(**{"dbtable": table, **jdbc}).load()
    schema = T.StructType(TABLES[table].fields + [
        T.StructField("stage", T.StringType()), T.StructField("batch", T.LongType())])
    try:
        rows = spark.read.schema(schema).parquet(f"{root}/{table}")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    if before is not None:
        rows = rows.filter((F.col("stage") != stage) | (F.col("batch") < before))
    return rows.drop("stage", "batch")


def append_rows(df: DataFrame, table: str, root: str, batch: int, stage: str = "load") -> None:
    """Write a batch of rows; writing it again replaces it."""
    names = [f.name for f in TABLES[table].fields]
    df.select(*names).write.mode("overwrite").parquet(f"{root}/{table}/stage={stage}/batch={batch}")


def _numbered(df: DataFrame, existing: DataFrame) -> DataFrame:
    """New ids for rows that may repeat: equal rows are counted, then told apart by a number."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    single = counted.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return assign_ids(single.withColumn("_key", F.to_json(F.struct(*df.columns, "_k"))), "_key", existing)


def append_metadata(messages: DataFrame, root: str, batch: int) -> None:
    """Insert decoded metadata messages, the checksum as hex."""
    rows = messages.select("locator", "name", bytes_to_hex(F.col("checksum")).alias("checksum"), "size")
    append_rows(_numbered(rows, read_catalog(messages.sparkSession, "metadata", root, before=batch)), "metadata", root, batch)


def append_geometadata(messages: DataFrame, root: str, batch: int) -> None:
    """Insert decoded geometadata messages, boxes from their corner points."""
    def box(name: str):
        b = F.col(name)
        return make_bounds(b["minX"], b["minY"], b["maxX"], b["maxY"])

    rows = messages.select("locator", F.col("crsCode").alias("native_srid"), F.col("nativeFormat").alias("native_format"),
                           box("nativeBoundingBox").alias("native_bounds"),
                           box("latitudeLongitudeBoundingBox").alias("latlon_bounds"))
    append_rows(_numbered(rows, read_catalog(messages.sparkSession, "geometadata", root, before=batch)), "geometadata", root, batch)
