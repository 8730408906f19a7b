"""Dataset inspection: size and checksum, format, bundles, extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.bounds import reproject_bounds

# A file longer than this does not fit in one value, so it has no content and no checksum.
MAX_BLOB = 2_000_000_000


def extract_metadata(uploads: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, locator, md5 checksum, size) per upload, and the uploads that cannot be read.

    `blobs` has locator, length, content. The checksum is taken before the join, so file bodies
    are not shuffled.
    """
    sums = blobs.select("locator", F.col("length").alias("size"),
                        F.md5("content").alias("checksum"))
    seen = uploads.select("name", "locator").join(sums, "locator", "left")
    good = seen.filter(F.col("checksum").isNotNull()).select("name", "locator", "checksum", "size")
    reason = F.when(F.col("size").isNull(), "no such blob").otherwise("too large")
    return good, seen.filter(F.col("checksum").isNull()).select("name", "locator", reason.alias("reason"))


def classify_format(content: Column) -> Column:
    """Format by leading bytes: TIFF (either byte order) or zip archive; anything else is null."""
    head = F.hex(F.substring(content, 1, 4))
    return (F.when(head.isin("49492A00", "4D4D002A"), "geotiff")
            .when(head.isin("504B0304", "504B0506"), "zip"))


def validate_bundles(files: DataFrame) -> DataFrame:
    """Per bundle of (bundle, name) rows: one base name throughout, and some `.shp` entry.

    The base name ends at the first dot. Smallest and largest name decide whether there is only
    one, so a bundle of any size is reduced before the shuffle.
    """
    base = F.regexp_replace("name", r"\..*$", "")
    return (files.groupBy("bundle").agg(
        F.count(F.lit(1)).alias("entries"),
        (F.min(base) == F.max(base)).alias("one_base"),
        F.bool_or(F.lower("name").like("%.shp")).alias("has_shape"))
        .withColumn("valid", F.col("one_base") & F.col("has_shape")))


def dataset_bounds(vertices: DataFrame, crs: str | Column = "EPSG:4326",
                   native_format: str = "zipped-shapefile") -> DataFrame:
    """Catalogue row per locator from its vertices or pixels (locator, x, y)."""
    code = F.lit(crs) if isinstance(crs, str) else crs
    grouped = vertices.groupBy("locator").agg(
        F.min("x").alias("minX"), F.max("x").alias("maxX"),
        F.min("y").alias("minY"), F.max("y").alias("maxY"))
    out = grouped.select("locator", code.alias("native_srid"), F.lit(native_format).alias("native_format"),
                         F.struct("minX", "maxX", "minY", "maxY").alias("native_bounds"))
    return out.withColumn("latlon_bounds", reproject_bounds("native_bounds", "native_srid"))


def split_reprojectable(boxes: DataFrame, srid: str = "native_srid") -> tuple[DataFrame, DataFrame]:
    """(rows with a known reference system, the others)."""
    known = F.coalesce(F.col(srid).isin("EPSG:4326", "EPSG:3857"), F.lit(False))
    return boxes.filter(known), boxes.filter(~known)


def crs_code(df: DataFrame, systems: DataFrame, by: str = "crs_name") -> DataFrame:
    """Adds the code of a named reference system; an unknown name gives null."""
    return df.join(systems.select(by, "code"), by, "left")


def check_states(deployments: DataFrame, states: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose state is allowed or null, the others)."""
    ok = F.coalesce(F.col("state").isin(*states), F.lit(True))
    return deployments.filter(ok), deployments.filter(~ok)
