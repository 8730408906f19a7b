"""Upload to catalogue: inspect new datasets, keep their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geoloom.functions.codecs import hex_to_bytes, split_bad, split_metadata
from geoloom.operators.inspection import dataset_bounds, extract_metadata
from geoloom.sources.blobs import read_landed
from geoloom.sources.tables import append_geometadata, append_metadata
from geoloom.sources.topics import write_topic


def start_stage(stream: DataFrame, work, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run a stage; `trigger` is Spark's, e.g. {"processingTime": "10 seconds"}, all there is now by default."""
    return (stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def geometadata_messages(boxes: DataFrame) -> DataFrame:
    """Catalogue rows of `dataset_bounds` in the form they travel."""
    return boxes.select("locator", F.col("native_srid").alias("crsCode"),
                        F.col("native_bounds").alias("nativeBoundingBox"),
                        F.col("latlon_bounds").alias("latitudeLongitudeBoundingBox"),
                        F.col("native_format").alias("nativeFormat"))


def inspect_uploads(uploads: DataFrame, blob_root: str, topic_root: str | None, checkpoint: str,
                    vertices: DataFrame | None = None, sink: dict | None = None, trigger: dict | None = None) -> StreamingQuery:
    """`uploads` messages in, `metadata` messages out: size and checksum of each file and, where
    its vertices are known, its extent. Messages that cannot be used go to `uploads-rejected`.
    `sink` goes to `write_topic`, e.g. fmt="kafka" and the brokers."""
    sink = sink or {}
    def work(batch: DataFrame, number: int) -> None:
        good, bad = split_bad(batch.select("value"), "upload")
        found, missing = extract_metadata(good, read_landed(batch.sparkSession, blob_root))
        sent = found.select("name", "locator", hex_to_bytes(F.col("checksum")).alias("checksum"), "size")
        write_topic(sent, "metadata", topic_root, batch=2 * number, **sink)
        if vertices is not None:
            known = vertices.join(good.select("locator").distinct(), "locator", "left_semi")
            write_topic(geometadata_messages(dataset_bounds(known)), "metadata", topic_root, batch=2 * number + 1, **sink)
        rejected = bad.select("value", "reason").unionByName(
            missing.select(F.col("locator").alias("value"), "reason"))
        write_topic(rejected, "uploads-rejected", topic_root, batch=number, **sink)
    return start_stage(uploads, work, checkpoint, trigger)


def persist_metadata(messages: DataFrame, table_root: str, topic_root: str | None, checkpoint: str,
                     sink: dict | None = None, trigger: dict | None = None) -> StreamingQuery:
    """`metadata` messages of both kinds into their tables, the rest to `metadata-rejected`."""
    sink = sink or {}
    def work(batch: DataFrame, number: int) -> None:
        md, geo, rest = split_metadata(batch.select("value"))
        append_metadata(md, table_root, number)
        append_geometadata(geo, table_root, number)
        write_topic(rest, "metadata-rejected", topic_root, batch=number, **sink)
    return start_stage(messages, work, checkpoint, trigger)
