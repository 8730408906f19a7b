"""Message topics as batch or streaming tables of (topic, value, arrived).

With `fmt="kafka"` topics live on brokers (the connector package has to be on the class path);
with `fmt="text"` a topic is a folder of text files under `root`, one message per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geoloom.functions.codecs import encode_columns
from geoloom.sources.blobs import path_below

# A topic's files lie in it directly or in one folder per batch.
_ALL_FILES = {"recursiveFileLookup": "true"}


def _load(spark: SparkSession, stream: bool, fmt: str, options: dict, path: str | None = None) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).format(fmt).options(**options)
    return reader.load(path) if path else reader.load()


def _kafka(df: DataFrame) -> DataFrame:
    return df.select("topic", F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrived"))


def read_topic(spark: SparkSession, topic: str, root: str | None = None, fmt: str = "text",
               stream: bool = True, **options) -> DataFrame:
    """One topic. Kafka options (brokers, starting offsets, …) go in by name."""
    if fmt == "kafka":
        return _kafka(_load(spark, stream, "kafka", {**options, "subscribe": topic}))
    rows = _load(spark, stream, "text", {**_ALL_FILES, **options}, f"{root}/{topic}")
    return rows.select(F.lit(topic).alias("topic"), "value",
                       F.col("_metadata.file_modification_time").alias("arrived"))


def read_topics(spark: SparkSession, pattern: str = ".*", root: str | None = None, fmt: str = "text",
                stream: bool = True, **options) -> DataFrame:
    """Every topic whose name matches a regular expression."""
    if fmt == "kafka":
        return _kafka(_load(spark, stream, "kafka", {**options, "subscribePattern": pattern}))
    rows = _load(spark, stream, "text", {**_ALL_FILES, **options}, root)
    name = F.substring_index(path_below(F.col("_metadata.file_path"), root), "/", 1)
    named = rows.select(name.alias("topic"), "value",
                        F.col("_metadata.file_modification_time").alias("arrived"))
    return named.filter(F.col("topic").rlike(f"^(?:{pattern})$"))


def write_topic(df: DataFrame, topic: str, root: str | None = None, fmt: str = "text",
                checkpoint: str | None = None, batch: int | None = None, trigger: dict | None = None,
                **options) -> StreamingQuery | None:
    """Publish rows as JSON messages.

    A stream starts a query, which is returned; `trigger` is Spark's, all there is now by default. A batch with a number
    replaces what an earlier try of that number wrote, so a retried micro-batch publishes once; Kafka gets it again.
    """
    messages = encode_columns(df)
    if fmt == "kafka":
        options = {**options, "topic": topic}
    if df.isStreaming:
        writer = messages.writeStream.format(fmt).options(**options).option("checkpointLocation", checkpoint)
        writer = writer.trigger(**(trigger or {"availableNow": True}))
        return writer.start(f"{root}/{topic}") if fmt == "text" else writer.start()
    if fmt == "kafka":
        messages.write.format("kafka").options(**options).save()
    elif batch is None:
        messages.write.mode("append").text(f"{root}/{topic}")
    else:
        messages.write.mode("overwrite").text(f"{root}/{topic}/batch={batch}")
    return None


def announce_uploads(uploads: DataFrame, **where) -> StreamingQuery | None:
    """Tell the inspectors about new datasets (name, locator)."""
    return write_topic(uploads.select("name", "locator"), "uploads", **where)
