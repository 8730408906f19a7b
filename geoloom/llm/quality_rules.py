"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio of trusted against raw text.

Tokens are runs of letters and digits (all non-ASCII counts as letters), lower-cased, and runs of other marks. Unigrams and
bigrams fall into a fixed number of buckets by their hash. Two multinomials over the buckets are counted, one over
all documents and one over trusted ones, and a document's ratio is the mean over its n-grams of
    log((trusted + prior) / (raw * trusted total / raw total + prior)),
so a bucket that trusted text has as often as the rest counts nothing and rare buckets count little. Every document is
held against the same threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.words import Block, kept_rows, mix, repeated, seen_before, span_hashes, spans, text_blocks, windows

BUCKETS = 1 << 15  # 128 KB of ratios, whatever the corpus
PRIOR = 20.0
THRESHOLD = -0.25  # nats an n-gram
BROADCAST_TRUSTED = 2_000_000  # ids of trusted documents up to this number are sent to all tasks, 16 MB; more are joined by a shuffle
SYMBOLS = b"#*$%&|<>"  # fixed value
_LETTER = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long, "
          "log_ratio double, base_failed boolean, kept boolean")


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def buckets(block: Block, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each unigram and bigram of a block, and the text that it is of."""
    starts, ends = (np.concatenate(x) for x in zip(spans(_LETTER[block.data]), spans(_MARK[block.data])))
    order = np.argsort(starts)
    starts, ends = starts[order], ends[order]
    one = span_hashes(block.data, starts, ends)
    own = np.searchsorted(block.edges, starts, "right") - 1
    two = windows(one, 2)[own[:-1] == own[1:]] if len(own) else one
    grams = mix(np.concatenate((one, two)))
    return (grams & np.uint64(count - 1)).astype(np.int64), np.concatenate((own, own[:-1][own[:-1] == own[1:]]))


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """Base counts of each text of a block."""
    data, edges, n = block.data, block.edges, len(block.counts)
    space = np.isin(data, np.frombuffer(b" \t\n\v\f\r", np.uint8))
    chars = ((data & 0xC0) != 0x80) & ~space
    lines = np.flatnonzero(data == 10)  # each text ends in one
    line_starts = np.concatenate(([0], lines[:-1] + 1))
    words_before = np.concatenate(([0], np.cumsum(~space)))
    full = words_before[lines] > words_before[line_starts]
    line_starts, line_ends = line_starts[full], lines[full]
    line_owner = np.searchsorted(edges, line_starts, "right") - 1
    again = seen_before(line_owner, span_hashes(data, line_starts, line_ends, lower=False))
    eight = windows(block.hashes(lower=False), 8)
    owner = block.owner()
    inside = owner[:len(eight)] == owner[7:] if len(eight) else np.zeros(0, bool)
    found = np.zeros(len(eight), bool)
    found[inside] = repeated(owner[:len(eight)][inside], eight[inside])
    covered = np.zeros(len(owner) + 1, np.int64)
    at = np.flatnonzero(found)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + 8, -1)
    return {"n_words": block.counts, "word_chars": sums(chars, edges), "n_symbols": sums(_SYMBOL[data], edges),
            "n_dup_lines": np.bincount(line_owner[again], minlength=n), "n_repeat_words": sums(np.cumsum(covered[:-1]) > 0, block.bounds)}


def ngram_counts(docs: DataFrame, trusted: DataFrame, count: int = BUCKETS) -> DataFrame:
    """(bucket, raw, trusted) over all documents; `trusted` has the doc_id of trusted ones."""
    def run(batches):
        raw, good = np.zeros(count, np.int64), np.zeros(count, np.int64)
        for batch in batches:
            flags = np.array(batch.column("trusted").to_pylist(), bool)
            for first, held in text_blocks(batch.column("text").to_pylist()):
                found, own = buckets(Block(held), count)
                raw += np.bincount(found, minlength=count)
                good += np.bincount(found[flags[first + own]], minlength=count)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, raw[at], good[at])], names=["bucket", "raw", "trusted"])

    known = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("trusted", F.lit(True))
    if known.limit(BROADCAST_TRUSTED + 1).count() <= BROADCAST_TRUSTED:
        known = F.broadcast(known)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).join(known, "doc_id", "left")
    parts = own.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")).mapInArrow(run, "bucket long, raw long, trusted long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def ratios(counts: DataFrame, count: int = BUCKETS, prior: float = PRIOR) -> np.ndarray:
    """The log ratio of each bucket; at most `count` rows come to the driver."""
    raw, good = np.zeros(count), np.zeros(count)
    for r in counts.collect():
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["trusted"]
    share = good.sum() / raw.sum() if good.sum() else 0.0
    return np.log((good + prior) / (raw * share + prior)) if share else np.zeros(count)


def judged(block: Block, table: np.ndarray, threshold: float) -> list[np.ndarray]:
    """The columns of SCHEMA after doc_id for the texts of a block."""
    base, (found, own), n = base_counts(block), buckets(block, len(table)), len(block.counts)
    grams = np.bincount(own, minlength=n)
    ratio = np.bincount(own, table[found], minlength=n) / np.maximum(grams, 1)
    failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
    return [*(base[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            grams.astype(np.int64), ratio, failed, ~failed & (ratio >= threshold)]


def quality_rules(docs: DataFrame, trusted: DataFrame, count: int = BUCKETS, prior: float = PRIOR, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, ratio and verdict for every document (doc_id, text).

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows. kept: not base_failed, and log_ratio
    is at or over `threshold`. Null and empty texts have zero counts, ratio 0 and fail the base rules. Rows with null or
    repeated ids are judged each; without trusted documents all ratios are 0. Other columns are not read.
    """
    table = ratios(ngram_counts(docs, trusted, count), count, prior)

    def run(batches):
        for batch in batches:
            parts = [judged(Block(held), table, threshold) for _, held in text_blocks(batch.column("text").to_pylist())]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.concatenate(c)) for c in zip(*parts))],
                                                 names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def passing(docs: DataFrame, trusted: DataFrame, count: int = BUCKETS, prior: float = PRIOR, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that quality_rules keeps."""
    table = ratios(ngram_counts(docs, trusted, count), count, prior)
    return kept_rows(docs, lambda held: judged(Block(held), table, threshold)[-1])
