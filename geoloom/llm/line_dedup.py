"""Lines that many documents share, dropped from all of them but one.

Long lines of every text are hashed and exploded; a hash that enough documents hold is dropped in all but the document of
the largest id; what is left is put together again by position. Digests and positions of lines are exchanged first, whole texts
once, with the positions that they lose.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.skew import computed_once, salted_join
from geoloom.session import shared_dir

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_LINES = 500_000  # repeated digests up to this many are sent to all tasks, about 60 MB there; more are joined by a shuffle


def line_key(line: Column) -> Column:
    """A line without blanks at both ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(BLANK)), UPPER, LOWER)


def _read_back(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def deduplicated(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, folder: str | None = None) -> DataFrame:
    """The rows (doc_id, text) with n_lines and n_dropped, and `text` without the lines that `min_docs` documents or more hold.

    Lines are split at \\n; a null or empty text is one empty line. Two lines are the same if their keys (`line_key`) are. Keys
    of fewer than `min_chars` code points are never dropped; others go where `min_docs` rows or more hold them, but for the
    row of the largest doc_id among these, which keeps all its lines of that key. Each row is a document, also where
    rows share an id; rows that share the largest id all keep the line, and null is smaller than any id. A text that
    loses every line is empty. An empty table gives no rows; further columns are not read. Digests of lines are written
    under `folder`, by default the cluster's checkpoint folder, and stay there, as the result reads them.
    """
    root = folder or re.sub(r"/?$", f"/lines-{uuid.uuid4().hex}", shared_dir(docs.sparkSession))
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    # Rows of one id and one text lose the same lines, so these two name a row: nothing depends on how a scan is split.
    keyed = computed_once(own, text_hash=F.xxhash64("text"), keys=F.transform(F.split("text", "\n", -1), line_key))
    long_lines = F.filter(F.transform("keys", lambda key, at: F.struct(at.alias("at"), F.when(F.length(key) >= min_chars, F.md5(key)).alias("digest"))),
                          lambda line: line["digest"].isNotNull())
    lines = _read_back(keyed.select("doc_id", "text_hash", long_lines.alias("lines")).filter(F.size("lines") > 0), f"{root}/digests")

    held = lines.select("doc_id", F.explode(F.array_distinct("lines.digest")).alias("digest"))
    counted = held.groupBy("digest").agg(F.count("*").alias("holders"), F.max("doc_id").alias("keeper")).filter(F.col("holders") >= min_docs)
    repeated = _read_back(counted.select("digest", "keeper"), f"{root}/repeated")
    found = lines.select("doc_id", "text_hash", F.inline("lines"))
    if repeated.count() <= BROADCAST_LINES:
        met = found.join(F.broadcast(repeated), "digest")
    else:
        met = salted_join(found, repeated, ["digest"], spread="text_hash")
    lost = met.filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = _read_back(lost.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("drop")), f"{root}/drops")

    marked = own.withColumn("text_hash", F.xxhash64("text"))
    gone = drops.withColumnsRenamed({"doc_id": "drop_doc", "text_hash": "drop_hash"}).hint("merge")
    joined = marked.join(gone, (marked["text_hash"] == gone["drop_hash"]) & marked["doc_id"].eqNullSafe(gone["drop_doc"]), "left")
    split = computed_once(joined.select("doc_id", "text", "drop"), parts=F.when(F.col("drop").isNotNull(), F.split("text", "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("drop"))
    kept = F.array_join(F.transform(stay, lambda at: F.get(F.col("parts"), at)), "\n")
    return split.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
                        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("text"))
