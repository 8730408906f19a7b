import os

from conftest import rows
from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.sources import blobs, features, tables, topics


def test_blobs_by_locator(spark, tmp_path, table):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "sub" / "b.bin").write_bytes(b"z")
    wanted = table("locator string", ("a.bin",), ("sub/b.bin",), ("none",))
    out = blobs.scan_blobs(spark, str(tmp_path), wanted).select("locator", "length", "found")
    assert rows(out, "locator") == [("a.bin", 3, True), ("none", None, False), ("sub/b.bin", 1, True)]


def test_landing_blobs_twice_keeps_one(spark, tmp_path, table):
    files = table("name string, content binary", ("x", b"abc"), ("y", b"abc"), ("z", b"d"))
    for _ in range(2):
        sent = blobs.land_blobs(files, str(tmp_path / "blobs"), 0)
    assert sent.select("locator").distinct().count() == 2
    assert blobs.read_landed(spark, str(tmp_path / "blobs")).count() == 2


def test_topics_round_trip(spark, tmp_path, table):
    root = str(tmp_path)
    ups = table("name string, locator string", ("a", "ds-1"), ("b", "ds-2"))
    topics.announce_uploads(ups, root=root, batch=0)
    topics.announce_uploads(ups, root=root, batch=0)  # a retry
    topics.write_topic(table("x int", (1,)), "other", root)
    back = topics.read_topic(spark, "uploads", root, stream=False)
    assert sorted(r.value for r in back.collect()) == ['{"name":"a","locator":"ds-1"}', '{"name":"b","locator":"ds-2"}']
    every = topics.read_topics(spark, "oth.*", root, stream=False)
    assert rows(every.select("topic", "value")) == [("other", '{"x":1}')]


def test_metadata_append_is_idempotent_and_keeps_repeats(spark, tmp_path, table):
    root = str(tmp_path)
    msgs = table("name string, locator string, checksum array<tinyint>, size long",
                 ("a", "ds-1", [-44, 29], 3), ("a", "ds-1", [-44, 29], 3), ("b", "ds-2", [0], 4))
    for _ in range(2):
        tables.append_metadata(msgs, root, 0)
    tables.append_metadata(msgs.filter("name = 'b'"), root, 1)
    out = tables.read_catalog(spark, "metadata", root)
    assert sorted(r.id for r in out.collect()) == [1, 2, 3, 4]
    assert {r.checksum for r in out.collect()} == {"d41d", "00"}
    assert out.filter("id = 4").first().name == "b"


def test_empty_catalog_table(spark, tmp_path):
    assert tables.read_catalog(spark, "leases", str(tmp_path)).count() == 0


def test_feature_loads_replace_and_drop(spark, tmp_path, table):
    root = str(tmp_path / "f")
    pts = table("locator string, id long, x double, y double", ("a", 1, 1.0, 1.0), ("a", 2, 2.0, 2.0), ("b", 3, 3.0, 3.0))
    pts = pts.select("locator", "id", g.point("x", "y").alias("geom"))
    features.load_features(pts, root, 1)
    features.load_features(pts.filter("id = 2"), root, 2)  # replaces dataset a
    out = features.read_features(spark, root)
    assert rows(out.select("id", F.col("geom.kind"), "minx"), "id") == [(2, "MULTIPOINT", 2.0), (3, "MULTIPOINT", 3.0)]
    features.drop_features(table("locator string", ("b",), ("nowhere",)), root, 3)
    assert rows(features.read_features(spark, root).select("id")) == [(2,)]
    assert features.read_features(spark, root, ["b"]).count() == 0
    plan = features.read_features(spark, root, ["a"]).filter("minx > 1")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThan(minx,1.0)" in plan
    ups = features.write_features(pts.filter("id = 3"), "result", root, 4)
    assert rows(ups) == [("result", "b")]
    assert os.path.isdir(f"{root}/data/load=4")
