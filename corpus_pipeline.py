"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes the documents that the one before has kept; all but the last return documents with all their columns.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm.decontamination import without_leaks
from geoloom.llm.jaccard import one_of_each_group
from geoloom.llm.packing import pack
from geoloom.llm.quality_classifier import accepted, train
from geoloom.llm.quality_rules import passing
from geoloom.llm.queries import BYTE_BPE, ready, trusted
from geoloom.session import shared_dir


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted(docs, train(docs, ready(spark).read.parquet(f"{sf_dir}/labels.parquet")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return passing(docs, trusted(ready(spark).read.parquet(f"{sf_dir}/labels.parquet")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    ready(spark)
    return one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    ready(spark)
    return pack(docs, BYTE_BPE)


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("ngram_jaccard", deduplicate), ("decontamination", decontaminate), ("packing", sequences)]
ORACLE_SQL = None  # the classifier, hashed ratios and the tokenizer can't be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the cluster's shared folder and read again."""
    root = re.sub(r"/?$", f"/pipeline-{uuid.uuid4().hex}", shared_dir(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
