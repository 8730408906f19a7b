"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

File format: records one after another, then one newline that ends the file. A record is
    length of the body     unsigned 64-bit
    masked checksum of the 8 length bytes   unsigned 32-bit
    body
    masked checksum of the body   unsigned 32-bit
all little-endian. The body holds doc_id (signed 64-bit), a flag (1: doc_id is null), the bytes of an id (2 or 4),
two zero bytes, the number of ids (unsigned 32-bit), then the ids. A masked checksum is the CRC-32 turned right by 15
bits plus a constant, so that checksums of data that hold checksums stay strong.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.bpe import encoded, encoder
from geoloom.session import shared_dir

MASK_DELTA = 0xA282EAD8  # fixed value: what is added to the turned checksum
SHARD_BYTES = 64 << 20  # a file is closed at this size, so a reader's memory is bounded by it or one record
HEAD, BODY = struct.Struct("<QI"), struct.Struct("<qBBxxI")
INDEX = "path string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, in_file long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    body = BODY.pack(doc_id or 0, doc_id is None, width, len(ids)) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(body))
    return b"".join((length, struct.pack("<I", masked(length)), body, struct.pack("<I", masked(body))))


def parse(data: bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    """(doc_id, ids, end) of the record at an offset; ValueError if a checksum doesn't hold."""
    size, check = HEAD.unpack_from(data, at)
    if masked(data[at:at + 8]) != check:
        raise ValueError(f"length at {at} is damaged")
    body, end = data[at + 12:at + 12 + size], at + 16 + size
    if len(data) < end or masked(body) != struct.unpack_from("<I", data, end - 4)[0]:
        raise ValueError(f"record at {at} is damaged")
    doc_id, null, width, n = BODY.unpack_from(body)
    return None if null else doc_id, np.frombuffer(body, f"<u{width}", n, BODY.size), end


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the ids of every document, closed by id 0, in ascending doc_id order (nulls first).

    Rows are dealt out by ranges of doc_id, a repeated doc_id by its text and place besides, so no id is a hot key.
    Spark's text writer puts the bytes down and commits them: lost tasks leave nothing behind, any store works.
    """
    def run(batches):
        width = 2 if encoder(tokenizer_path).tokenizer.get_vocab_size() <= 1 << 16 else 4
        held, size = [], 0
        for names, data in encoded(batches, tokenizer_path):
            for doc_id, own in zip(names, data):
                held.append(frame(doc_id, np.frombuffer(own + b"\0\0\0\0", "<u4"), width))
                size += len(held[-1])
                if size >= shard_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").asc_nulls_first(), "tie", "place"]
    (own.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "value binary")
        .select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(folder))


def scan_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the files, checked: path, offset, length, doc_id, n_tokens, ids_crc32 and ids before it there."""
    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path"), batch.column("content")):
                path, data, rows, at, before = path.as_py(), data.as_py(), [], 0, 0
                while at < len(data) - 1:
                    doc_id, ids, end = parse(data, at)
                    rows.append((path, at, end - at, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), before))
                    at, before = end, before + len(ids)
                kinds = [pa.string()] + [pa.int64()] * 6
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in INDEX.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(run, INDEX)


def write_index(spark: SparkSession, folder: str, index_folder: str) -> DataFrame:
    """Write the offset index of a folder of records and return it with `start`, the ids of all earlier records."""
    scan_records(spark, folder).write.parquet(index_folder)
    index = spark.read.schema(INDEX).parquet(index_folder)
    part = [F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)", k).cast("long") for k in (1, 2)]
    files = index.groupBy("path").agg(F.sum("n_tokens").alias("n")).select("path", "n", part[0].alias("task"), part[1].alias("file"))
    # One row a file, so the running sum over files is small; the files are in doc_id order.
    before = files.select(F.col("path"), F.coalesce(F.sum("n").over(Window.orderBy("task", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return index.join(before, "path").withColumn("start", F.col("before") + F.col("in_file")).drop("before")


def read_shuffled(spark: SparkSession, index: DataFrame, folder: str, seed: int) -> DataFrame:
    """(doc_id, ids, place) of every indexed record in an order drawn by `seed`: each file is read once, by offsets."""
    def run(batches):
        for batch in batches:
            for data, offsets in zip(batch.column("content"), batch.column("offsets")):
                data, found = data.as_py(), []
                for at in offsets.as_py():
                    doc_id, ids, _ = parse(data, at)
                    found.append((doc_id, ids.tolist(), at))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.list_(pa.int64()), pa.int64()))], names=["doc_id", "ids", "offset"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    # A file's offsets are bounded by its size.
    wanted = index.groupBy("path").agg(F.collect_list("offset").alias("offsets"))
    rows = files.join(wanted, "path").select("content", "offsets").mapInArrow(run, "doc_id long, ids array<long>, offset long")
    return rows.orderBy(F.xxhash64("doc_id", "offset", F.lit(seed)))


def token_records(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write records and index under `folder` (by default the cluster's checkpoint folder) and return what reads give.

    Null text: no ids but the end. Repeated ids: each row has its record. An empty table: no records, no rows. Other
    columns of `docs` are not read.
    """
    spark = docs.sparkSession
    root = folder or re.sub(r"/?$", f"/records-{uuid.uuid4().hex}", shared_dir(spark))
    write_records(docs, tokenizer_path, f"{root}/data")
    return write_index(spark, f"{root}/data", f"{root}/index").select("doc_id", "start", "n_tokens", "ids_crc32", "path", "offset")
