"""Tables written through the sinks, a batch repeated as a retry does, and read back through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.functions.codecs import hex_to_bytes
from geoloom.session import shared_dir
from geoloom.sources import blobs, features, tables, topics
from suite.registry import query


def folder(t) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/suite-{uuid.uuid4().hex}"


def uploads(t):
    return t("f_metadata").select("name", "locator")


@query("select locator, max(length) as length, count(*) as copies from (select sha256(text) as locator, strlen(text) as length from documents) group by locator")
def landed_blobs(t):
    root, files = folder(t), t("documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("content"))
    for _ in range(2):
        sent = blobs.land_blobs(files, root, 0)
    return blobs.read_landed(t.spark, root).join(sent.groupBy("locator").agg(F.count("*").alias("copies")), "locator").select("locator", "length", "copies")


@query("select cast(sum(length(name) + 1) as bigint) as length, count(distinct name[-1:]) > 0 as some from f_metadata")
def scanned_blobs(t):
    root = folder(t)
    t("f_metadata").select("name").write.text(root)  # one byte more a row, its newline
    found = blobs.scan_blobs(t.spark, root)
    return found.agg(F.sum(F.length("content")).alias("length"), (F.count("locator") > 0).alias("some"))


@query("select name, locator from f_metadata")
def announced_uploads(t):
    root = folder(t)
    for _ in range(2):
        topics.announce_uploads(uploads(t), root=root, batch=0)
    back = topics.read_topic(t.spark, "uploads", root, stream=False)
    return back.select(F.from_json("value", "name string, locator string").alias("m")).select("m.*")


@query("""
select 'servers' as topic, count(*) as messages, count(distinct host) as kinds from f_servers
union all select 'sites', count(*), count(distinct locator) from f_sites""")
def topics_by_pattern(t):
    root = folder(t)
    for name, key in (("servers", "host"), ("sites", "locator"), ("points", "locator")):
        topics.write_topic(t("f_" + name).select(F.col(key).alias("key"), "id"), name, root, batch=1)
    back = topics.read_topics(t.spark, "s.*", root, stream=False)
    return back.groupBy("topic").agg(F.count("*").alias("messages"), F.count_distinct(F.get_json_object("value", "$.key")).alias("kinds"))


@query("""
with m as (select locator, name, checksum, size from f_metadata),
all_rows as (select * from m union all select * from m where size % 2 = 0)
select locator, name, checksum, size, count(*) as rows, (select count(*) from all_rows) as ids from all_rows group by locator, name, checksum, size""")
def appended_metadata(t):
    root = folder(t)
    messages = t("f_metadata").select("name", "locator", hex_to_bytes(F.col("checksum")).alias("checksum"), "size")
    for batch, rows in ((0, messages), (0, messages), (1, messages.filter("size % 2 = 0"))):
        tables.append_metadata(rows, root, batch)
    back = tables.read_catalog(t.spark, "metadata", root)
    ids = back.agg(F.count_distinct("id").alias("ids"))  # one row
    return back.groupBy("locator", "name", "checksum", "size").agg(F.count("*").alias("rows")).crossJoin(F.broadcast(ids))


@query("select locator, native_srid, native_format, minx, maxx, miny, maxy from f_geometadata")
def appended_geometadata(t):
    root, names = folder(t), ("minX", "minY", "maxX", "maxY")
    box = F.struct(*[F.col(n.lower()).alias(n) for n in names])
    messages = t("f_geometadata").select("locator", F.col("native_srid").alias("crsCode"), box.alias("nativeBoundingBox"), box.alias("latitudeLongitudeBoundingBox"),
                                         F.col("native_format").alias("nativeFormat"))
    for _ in range(2):
        tables.append_geometadata(messages, root, 0)
    back = tables.read_catalog(t.spark, "geometadata", root)
    return back.select("locator", "native_srid", "native_format", *[F.col("native_bounds")[n].alias(n.lower()) for n in names])


@query("""
with n as (select locator, id, x, y, cast(substr(locator, 4) as bigint) as no from f_sites)
select locator, id, case when no % 5 = 1 then x + 1 else x end as x, y from n where no % 5 <> 0
union all select 'made', id, x, y from n where no % 5 = 0""")
def stored_features(t):
    """All sites loaded twice, some datasets loaded anew moved, some dropped, and a result written as a dataset of its own."""
    root, no = folder(t), F.substring("locator", 4, 30).cast("long") % 5
    sites = t("f_sites").select("locator", "id", "x", "y")
    shaped = lambda df: df.select("locator", "id", g.point(F.col("x"), F.col("y")).alias("geom"))
    for _ in range(2):
        features.load_features(shaped(sites), root, 1)
    features.load_features(shaped(sites.filter(no == 1).withColumn("x", F.col("x") + 1)), root, 2)
    features.drop_features(sites.filter(no == 0).select("locator"), root, 3)
    features.write_features(shaped(sites.filter(no == 0).withColumn("locator", F.lit("made"))), "result", root, 4)
    spot = g.vertices(F.col("geom"))[0]
    return features.read_features(t.spark, root).select("locator", "id", spot["x"].alias("x"), spot["y"].alias("y"))
