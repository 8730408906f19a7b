import json
import time

from conftest import rows
from pyspark.sql import functions as F

from geoloom.functions.codecs import bytes_to_hex, decode
from geoloom.operators.folds import latest
from geoloom.plans import jobs
from geoloom.plans.leases import match_grants
from geoloom.plans.catalog import keyword_search
from geoloom.sources import blobs, tables, topics
from geoloom.streaming import ingest
from geoloom.streaming import jobs as job_streams
from geoloom.streaming import leases as lease_streams


def put(root, topic, name, *lines):
    folder = root / topic
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(line + "\n" for line in lines))


def drain(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_upload_to_search(spark, tmp_path, table):
    """Files land, are announced, inspected, catalogued and found."""
    top, tab = str(tmp_path / "topics"), str(tmp_path / "tables")
    files = table("name string, content binary", ("roads_en.zip", b"abc"), ("rivers.zip", b"defg"))
    ups = blobs.land_blobs(files, str(tmp_path / "blobs"), 0)
    topics.announce_uploads(ups, root=top, batch=0)
    put(tmp_path / "topics", "uploads", "extra.txt", '{"broken":', '{"name":"gone","locator":"nowhere"}')
    roads = [r.locator for r in ups.collect() if r.name == "roads_en.zip"][0]
    vertices = table("locator string, x double, y double", (roads, 1.0, 2.0), (roads, 3.0, 5.0))

    ingest.inspect_uploads(topics.read_topic(spark, "uploads", top), str(tmp_path / "blobs"), top,
                           str(tmp_path / "c1"), vertices).awaitTermination(180)
    ingest.persist_metadata(topics.read_topic(spark, "metadata", top), tab, top,
                            str(tmp_path / "c2")).awaitTermination(180)

    md, geo = tables.read_catalog(spark, "metadata", tab), tables.read_catalog(spark, "geometadata", tab)
    assert {(r.name, r.size) for r in md.collect()} == {("roads_en.zip", 3), ("rivers.zip", 4)}
    assert md.filter("name like 'roads%'").first().checksum == "900150983cd24fb0d6963f7d28e17f72"
    none = table("id long, locator string, server long, state string")
    hit = keyword_search(md, geo, none, "en").first()
    assert hit.name == "roads_en.zip" and json.loads(hit.latlon_bbox)["type"] == "Polygon" and not hit.deployed
    rejected = topics.read_topic(spark, "uploads-rejected", top, stream=False)
    assert rejected.count() == 2


def test_lease_request_to_grant(spark, tmp_path, table):
    top, tab = tmp_path / "topics", str(tmp_path / "tables")
    tables.append_rows(table("id long, host string, port long, local_path string, response_time long",
                             (1, "h1", 80, "/d", None), (2, "h2", 81, "/d", 5)), "servers", tab, 0)
    ask = lambda loc, *tag: json.dumps({"locator": loc, "timeout": 3600000, "tag": list(tag)})
    put(top, "lease-requests", "a.txt", ask("ds-1", 1, 1), ask("ds-1", 2, -2), ask("ds-2", 3, 3), "junk")
    now = F.lit("2020-01-01 00:00:00").cast("timestamp")

    def lease():
        lease_streams.serve_lease_requests(topics.read_topic(spark, "lease-requests", str(top)), tab, str(top),
                                           str(tmp_path / "c1"), now).awaitTermination(180)
    lease()
    deployed = topics.read_topic(spark, "deploy-requests", str(top), stream=False)
    assert sorted(json.loads(r.value)["locator"] for r in deployed.collect()) == ["ds-1", "ds-2"]
    assert {json.loads(r.value)["server"]["host"] for r in deployed.collect()} == {"h2"}
    lease_streams.serve_deploy_requests(topics.read_topic(spark, "deploy-requests", str(top)), tab, str(top),
                                        str(tmp_path / "c2"), now).awaitTermination(180)
    current = latest(tables.read_catalog(spark, "deployments", tab))
    assert sorted((r.locator, r.state) for r in current.collect()) == [("ds-1", "live"), ("ds-2", "live")]
    assert tables.read_catalog(spark, "leases", tab).count() == 3
    put(top, "lease-requests", "b.txt", ask("ds-1", 9))  # now live: granted at once
    lease()
    grants = decode(topics.read_topic(spark, "lease-grants", str(top), stream=False), "lease_granted")
    got = grants.select(bytes_to_hex(F.col("record.tag")).alias("tag"), "record.timeout")
    assert rows(got, "tag") == [("0101", 0), ("02fe", 0), ("0303", 0), ("09", 3600000)]


def test_grants_match_requests_in_streams(spark, tmp_path):
    reqs, grants = tmp_path / "r", tmp_path / "g"
    put(tmp_path, "r", "1.txt", "a", "b", "b")
    put(tmp_path, "g", "1.txt", "a", "a", "z")
    time.sleep(1)

    def read(folder):
        rows_in = spark.readStream.format("text").load(str(folder))
        return rows_in.select(F.col("value").alias("tag"), F.lit("ds").alias("locator"), F.lit(0).alias("timeout"),
                              F.col("_metadata.file_modification_time").alias("arrived"))
    out = drain(lease_streams.match_grants_stream(read(reqs), read(grants)), spark, "matched")
    assert [r.tag for r in out.collect()] == ["a"]


EVENTS = [(1, "a", "pending"), (2, "a", "started"), (3, "a", "assigned"), (4, "b", "assigned"), (5, "a", "started"),
          (6, "a", "progress"), (7, "a", "progress"), (8, "a", "done"), (9, "a", "progress"), (10, "c", "pending"),
          (11, "c", "aborted"), (12, "c", "assigned"), (13, "a", "pending")]


def test_job_stream_equals_batch(spark, tmp_path, table):
    events = table("seq long, id string, status string", *EVENTS)
    for i in range(3):  # three files, one micro-batch each
        part = events.filter(F.col("seq").between(i * 5 + 1, i * 5 + 5))
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(0.1)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = drain(job_streams.job_transitions_stream(stream), spark, "moves", "append")
    assert rows(out, "seq") == rows(jobs.job_transitions(events), "seq")


def test_first_submission_in_stream(spark, tmp_path, table):
    put(tmp_path, "s", "1.txt", "1", "1", "2", "7")
    stream = spark.readStream.format("text").load(str(tmp_path / "s")).select(
        F.col("value").alias("id"), F.col("_metadata.file_modification_time").alias("arrived"))
    out = drain(job_streams.accept_submissions_stream(stream, table("id string", ("1",), ("2",))), spark, "accepted")
    assert sorted(r.id for r in out.collect()) == ["1", "2"]


def dealt(df, root, *batches):
    """A stream of one file and micro-batch for each list of row numbers."""
    root.mkdir()
    held = df.collect()
    for i, part in enumerate(batches):
        df.sparkSession.createDataFrame([held[k] for k in part], df.schema).coalesce(1).write.mode("append").json(str(root / f"b={i}"))
        time.sleep(0.1)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(root))


def test_reports_out_of_order_equal_batch(spark, tmp_path, table):
    """Neighbours are swapped within a batch and over batches; the last row only moves the watermark on."""
    log = [*EVENTS, (14, None, "pending"), (15, "d", "unheard of"), (16, "d", "pending")]
    events = table("seq long, id string, status string", *log, (900, "z", "done")).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    stream = dealt(events, tmp_path / "in", [2, 0], [3, 1, 4], [6, 5, 8], [7], [11, 10, 13], [9, 12, 15], [14], [16])
    out = drain(job_streams.ordered_transitions_stream(stream, "5 minutes"), spark, "ordered")
    assert rows(out, "seq") == rows(jobs.job_transitions(events), "seq")


def test_ended_jobs_are_forgotten(spark, tmp_path, table):
    log = [(1, "a", "pending"), (2, "a", "aborted"), (50, "z", "done"), (60, "a", "pending"), (90, "z", "done")]
    events = table("seq long, id string, status string", *log).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    out = drain(job_streams.ordered_transitions_stream(dealt(events, tmp_path / "in", [0, 1], [2], [3], [4]), "1 minute", 600_000), spark, "forgotten")
    assert [(r.seq, r.old_status) for r in out.orderBy("seq").collect()] == [(1, None), (2, "pending"), (60, None)]
    out = drain(job_streams.ordered_transitions_stream(dealt(events, tmp_path / "on", [0, 1], [2], [3], [4]), "1 minute"), spark, "remembered")
    assert [r.seq for r in out.orderBy("seq").collect()] == [1, 2]


def test_first_by_seq_wins_and_used_ids_stay_used(spark, tmp_path, table):
    log = [("1", 3, "late"), ("1", 2, "first"), ("2", 5, "only"), ("7", 1, "never issued"), (None, 4, "none"), ("z", 400, "moves on"), ("1", 900, "again"), ("2", 901, "again"),
           ("z", 5000, "moves on")]
    subs = table("id string, seq long, parameters string", *log).withColumn("arrived", F.timestamp_seconds(F.col("seq") * 60))
    issued = table("id string", ("1",), ("2",), ("3",), ("2",))
    stream = dealt(subs, tmp_path / "in", [0], [1, 2, 3, 4], [5], [6, 7], [8])
    out = drain(job_streams.first_submissions_stream(stream, issued, "5 minutes"), spark, "firsts")
    got = rows(out.select("id", "seq", "parameters"), "seq")
    assert got == [("1", 2, "first"), ("2", 5, "only")]
    assert got == rows(jobs.accept_submissions(subs, issued).select("id", "seq", "parameters"), "seq")


def test_answers_of_requests_equal_batch(spark, tmp_path, table):
    """Grants before their requests, two grants or requests of a tag, late rows, and requests that are never granted."""
    asks = [("a", "ds-1", 1), ("b", "ds-2", 2), ("c", "ds-3", 6), ("c", "ds-3", 7), ("d", "ds-4", 8), ("e", "ds-5", 9), (None, "ds-6", 10), ("z", "none", 300), ("z", "none", 2000)]
    gives = [("a", 0, 4), ("a", 5, 3), ("c", 7, 5), ("e", None, 30), ("f", 1, 12), ("d", 9, 200)]
    asked = table("tag string, locator string, seq long", *asks).withColumn("arrived", F.timestamp_seconds(F.col("seq") * 60))
    given = table("tag string, timeout long, seq long", *gives).withColumn("arrived", F.timestamp_seconds(F.col("seq") * 60))
    streams = dealt(asked, tmp_path / "asked", [1, 0], [3, 2, 4], [5, 6], [7], [8]), dealt(given, tmp_path / "given", [0, 2], [1], [3, 4], [5])
    out = drain(lease_streams.answered_stream(*streams, "5 minutes", 60 * 60_000), spark, "answers")
    got = {r.tag: r for r in out.filter("tag <> 'z'").collect()}
    want = {r.tag: r for r in match_grants(asked.filter("tag <> 'z'"), given.filter("seq < 200")).collect()}  # d's grant comes after its hour
    assert out.filter("tag <> 'z'").count() == len(got) and set(got) == set(want) == {"a", "b", "c", "d", "e"}
    for tag, row in got.items():
        assert row.asDict() == {k: want[tag][k] for k in row.asDict()}, tag
    assert not got["b"].granted and not got["d"].granted and got["e"].granted and got["e"].grant_timeout is None and got["a"].grant_seq == 3
