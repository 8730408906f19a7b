"""The pipeline's stages on the smallest tables and on odd ones, against what the operators say row by row."""

import __spark_entry__ as entry_point
import corpus_pipeline
import pytest
from geoloom.llm.decontamination import leaks
from geoloom.llm.jaccard import jaccard_groups
from geoloom.llm.quality_classifier import score, train
from geoloom.llm.quality_rules import quality_rules
from geoloom.llm.queries import trusted

SF_DIR = "/root/testdata/sf0.001"


def test_registered():
    names = entry_point.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{n}" for n in range(1, 14)} and "pipeline" in names


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) of each stage; the input of the first has nulls, repeats and a clashing column besides."""
    root, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10 ** 6, "", "en", "x", 0), (3, None, "en", "x", 0)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.filter("doc_id < 5")).selectExpr("*", "doc_id as place", "'x' as gram")
    docs.write.parquet(str(root / "in"))
    docs = spark.read.parquet(str(root / "in"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(root / name))
        found = spark.read.parquet(str(root / name))
        out[name], docs = (docs, found), found
    return out


def ids(df):
    return sorted((-1 if r.doc_id is None else r.doc_id) for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        assert name == "packing" or after.columns == before.columns


def test_decisions(stages, spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    before, after = stages["quality_classifier"]
    assert ids(after) == ids(score(before, train(before, labels)).filter("predicted = 1"))
    before, after = stages["quality_rules"]
    assert ids(after) == ids(quality_rules(before, trusted(labels)).filter("kept"))
    before, after = stages["ngram_jaccard"]
    groups = jaccard_groups(before).select("doc_id", "component_id").collect()
    assert ids(after) == sorted({g.component_id for g in groups})
    before, after = stages["decontamination"]
    found = {r.doc_id for r in leaks(before, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).collect()}
    assert ids(after) == [i for i in ids(before) if i not in found]


def test_everything_is_packed(stages):
    before, pieces = stages["packing"]
    whole = {}
    for r in pieces.collect():
        whole.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert sorted(whole) == ids(before) and all(a == b for a, b in whole.values())


def test_an_empty_table_goes_through(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0
