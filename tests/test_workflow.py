import random

from conftest import rows
from pyspark.sql import functions as F

from geoloom.functions import codecs
from geoloom.operators.folds import assign_ids
from geoloom.operators.inspection import validate_bundles
from geoloom.plans import jobs, leases, requests


def brute(events):
    """(final states, applied reports) of a log, one event after the other."""
    state, applied = {}, []
    for seq, job, status in sorted(events):
        old = state.get(job, "none")
        if status in jobs.MOVES[old]:
            applied.append((job, seq, None if old == "none" else old, status))
            state[job] = status
    return sorted(state.items()), sorted(applied)


def test_job_fold_equals_sequential_loop(table):
    random.seed(5)
    names = jobs.STATES[1:] + ["nonsense"]
    events = [(i, f"j{random.choice([0, 0, 0, 1, 2])}", random.choice(names[:4] * 3 + names)) for i in range(600)]
    df = table("seq long, id string, status string", *events)
    final, applied = brute(events)
    for levels, width in ((3, 512), (2, 3), (1, 7), (0, 1)):  # block borders fall everywhere
        assert sorted(map(tuple, jobs.fold_job_status(df, levels, width).collect())) == final
        assert sorted(map(tuple, jobs.job_transitions(df, levels, width).collect())) == applied


def test_job_fold_cases(table):
    log = [(1, "a", "pending"), (2, "a", "aborted"), (3, "a", "started"), (4, "x", "done"), (5, "b", "pending"),
           (6, "b", "pending"), (7, "b", "assigned"), (8, "b", "started"), (9, "b", "done"), (10, "b", "progress")]
    df = table("seq long, id string, status string", *log)
    assert rows(jobs.fold_job_status(df), "id") == [("a", "aborted"), ("b", "done")]
    again = df.unionByName(df.withColumn("seq", F.col("seq") + 100))  # the same log a second time changes nothing
    assert rows(jobs.fold_job_status(again), "id") == [("a", "aborted"), ("b", "done")]


def test_submissions_and_routing(table):
    sent = table("id string, seq long, service string", ("1", 5, "s"), ("1", 2, "t"), ("9", 1, "s"))
    got = jobs.accept_submissions(sent, table("id string", ("1",), ("2",)))
    assert rows(got) == [("1", 2, "t")]
    good, bad = jobs.route_jobs(sent, table("service string, topic string", ("s", "q")))
    assert good.count() == 2 and rows(bad.select("service")) == [("t",)]


def test_lease_routing_modes(table):
    dep = table("id long, locator string, server long, state string", (1, "live", 1, "live"), (2, "wait", 1, "starting"), (3, "kill", 1, "killing"))
    srv = table("id long, host string, port long, local_path string, response_time long", (1, "h", 80, "/", None))
    none = table("id long, locator string, deployment long, lifetime timestamp, tag string")
    req = table("seq long, locator string, timeout long, tag string",
                (1, "live", 9, "t1"), (2, "wait", 9, "t2"), (3, "dead", 9, "t3"), (4, "dead", 9, "t4"), (5, "kill", 9, "t5"))
    now = F.lit("2020-01-01 00:00:00").cast("timestamp")
    out = leases.route_lease_requests(req, dep, srv, none, now, "attempt")
    assert rows(out.requests.select("seq", "outcome"), "seq") == [
        (1, "live"), (2, "starting"), (3, "started"), (4, "starting"), (5, "started")]
    assert rows(out.leases.select("tag", F.col("lifetime").isNull()), "tag") == [
        ("t1", False), ("t2", True), ("t3", False), ("t4", True), ("t5", False)]
    assert rows(out.grants) == [("live", 9, "t1")]
    assert sorted(r.locator for r in out.deploy_requests.collect()) == ["dead", "kill"]
    assert sorted(r.id for r in out.deployments.collect()) == [4, 5]
    ids = {r.seq: r.deployment for r in out.requests.collect()}
    assert ids[3] == ids[4] and ids[3] != ids[5]
    no_server = leases.route_lease_requests(req, dep, srv.limit(0), none, now)
    assert no_server.deployments.count() == 0
    assert out.unserved.count() == 0
    assert {r.seq for r in no_server.unserved.collect()} == {1, 2, 3, 4, 5} - {r.seq for r in no_server.requests.collect()}
    assert {3, 4, 5} <= {r.seq for r in no_server.unserved.collect()}
    nameless = table("seq long, locator string, timeout long, tag string", (1, None, 9, "t1"))
    assert rows(leases.route_lease_requests(nameless, dep, srv, none, now).unserved) == [(1, None, 9, "t1")]


def test_first_grant_only(table):
    asked = table("tag string, locator string, seq long", ("a", "x", 1), ("b", "y", 2))
    given = table("tag string, timeout long, seq long", ("a", 7, 3), ("a", 0, 9), ("z", 1, 1))
    out = leases.match_grants(asked, given).select("tag", "grant_timeout", "granted")
    assert rows(out, "tag") == [("a", 7, True), ("b", None, False)]


def test_ids_are_dense_and_stable(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    a = assign_ids(df, "key", 100)
    assert a.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first() == (101, 5100, 5000)
    assert a.exceptAll(assign_ids(df.repartition(7), "key", 100)).count() == 0


def test_bundles(table):
    files = table("bundle string, name string", ("ok", "r.shp"), ("ok", "r.dbf"), ("up", "r.SHP"), ("two", "a.shp"), ("two", "b.dbf"),
                  ("none", "r.dbf"), ("dots", "r.shp.xml"), ("dots", "r.a.shp"))
    out = validate_bundles(files).select("bundle", "valid")
    assert rows(out, "bundle") == [("dots", True), ("none", False), ("ok", True), ("two", False), ("up", True)]


def test_request_parsing(table):
    urls = ["http://p/geoserver/wms?LAYERS=catalog:old&layers=catalog:new", "http://p/geoserver/wms?SERVICE=wfs&typeName=a,b",
            "http://p/geoserver/wcs?CoverageID=a,b", "http://p/geoserver/ows?LAYERS=x", "http://p/geoserver/ows?service=WMS&layers=a%20b",
            "http://p/geoserver/wms?service=bogus&layers=x", "http://p/other/wms?layers=x", "http://p/geoserver/wfs"]
    out = requests.parse_requests(table("req_id long, url string", *enumerate(urls)))
    assert rows(out.select("service", "locator", "reject"), "req_id") == [
        ("WMS", "new", None), ("WFS", None, "several datasets"), ("WCS", "a,b", None), (None, None, "no service"),
        ("WMS", "a b", None), ("WMS", "x", None), (None, None, "no service"), ("WFS", None, "no dataset")]


def test_server_choice(table):
    dep = table("id long, locator string, server long, state string", (1, "one", 3, "live"), (2, "three", 3, "live"),
                (3, "three", 1, "live"), (4, "three", 2, "live"), (5, "none", 1, "dead"))
    srv = table("id long, host string, port long, local_path string", *[(i, f"h{i}", 80, "/") for i in (1, 2, 3)])
    req = table("req_id long, url string", *[(i, f"http://p/geoserver/wms?layers={n}&x=1") for i, n in enumerate(["one", "three", "none"])])
    out = requests.route_requests(req, dep, srv).select("server", "target", "outcome")
    assert rows(out, "req_id") == [(3, "http://h3:80/geoserver/wms?layers=one&x=1", "routed"),
                                   (2, "http://h2:80/geoserver/wms?layers=three&x=1", "routed"), (None, None, "not found")]
    many = table("req_id long, url string", *[(i, "http://p/geoserver/wms?layers=three") for i in range(60)])
    spread = requests.route_requests(many, dep, srv, policy="hash").groupBy("server").count()
    assert sorted(r.server for r in spread.collect()) == [1, 2, 3]


def test_codec_cases(table):
    lines = table("topic string, value string",
                  ("uploads", '{"name":"a.zip","locator":"ds-1"}'), ("uploads", '{"name":"a.zip"}'), ("metadata", '{"broken":'),
                  ("metadata", '{"name":"a.zip","locator":"ds-1","checksum":[-44,29,-128],"size":12}'), ("nobody", "é"))
    out = dict(rows(codecs.decode_any(lines).select("value", "body")))
    assert out['{"name":"a.zip"}'] == '{"name":"a.zip"}'.encode().hex().upper()
    assert out["é"] == "C3A9" and out['{"broken":'] == b'{"broken":'.hex().upper()
    md, geo, rest = codecs.split_metadata(lines.filter("topic = 'metadata'"))
    assert rows(md.select(codecs.bytes_to_hex(F.col("checksum")))) == [("d41d80",)]
    assert geo.count() == 0 and rest.count() == 1
    live = table("value string", ('{"status":"live","id":1}',), ('{"status":"dead"}',), ('{"status":"killing","id":1}',))
    assert [r.record is None for r in codecs.decode(live, "deploy_status").collect()] == [True, False, True]
    hexes = table("h string", ("",), ("00ff7f80",))
    assert rows(hexes.select(codecs.bytes_to_hex(codecs.hex_to_bytes(F.col("h"))))) == [("",), ("00ff7f80",)]
    stamps = table("s string", ("2020-01-01 00:00:00.5",), ("2020-13-01 00:00:00",), ("soon",), (None,))
    assert [r[0] for r in stamps.select(codecs.write_stamp(codecs.read_stamp(F.col("s")))).collect()] == [
        "2020-01-01 00:00:00.5", None, None, None]
