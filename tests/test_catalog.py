import pytest
from conftest import rows
from pyspark.sql import functions as F

from geoloom.functions.bounds import bounds_geojson, make_bounds, overall_extent, reproject_bounds
from geoloom.plans import catalog, publish

BOX = "struct<minX:double,maxX:double,minY:double,maxY:double>"


@pytest.fixture
def md(table):
    return table("id long, locator string, name string, checksum string, size long",
                 (1, "a", "Roads_EN", "c1", 1), (2, "b", "roads%en", "c2", 2), (3, "c", "roadsxen", "c3", 3),
                 (4, "d", "rivers", "c4", 4))


@pytest.fixture
def geo(table):
    box = (0.0, 1.0, 2.0, 3.0)
    return table(f"id long, locator string, native_srid string, native_format string, native_bounds {BOX}, latlon_bounds {BOX}",
                 (1, "b", "EPSG:4326", "geotiff", box, box), (2, "b", "EPSG:3857", "geotiff", box, box),
                 (3, "c", "EPSG:4326", "zipped-shapefile", box, box))


@pytest.fixture
def deployments(table):
    return table("id long, locator string, server long, state string",
                 (1, "c", 1, "dead"), (2, "c", 1, "killing"), (3, "b", 2, "live"), (4, "b", 1, "live"), (5, "e", 9, "live"),
                 (6, "f", 1, "starting"), (7, "f", 1, "dead"))


@pytest.fixture
def servers(table):
    return table("id long, host string, port long, local_path string, response_time long",
                 (1, "h1", 80, "/1", None), (2, "h2", 81, "/2", 7))


def names(df):
    return [r.name for r in df.collect()]


def test_search_wildcards_case_and_repeats(md, geo, deployments):
    search = lambda k, **o: catalog.keyword_search(md, geo, deployments, k, **o)
    assert names(search("EN")) == ["Roads_EN"]
    assert names(search("s_en")) == ["roads%en", "roads%en", "roadsxen"]  # two boxes of one dataset, `_` is wild
    assert names(search("roads%n")) == ["roads%en", "roads%en", "roadsxen"]
    assert names(search("s", limit=2)) == ["Roads_EN", "roads%en"]
    hits = {(r.locator, r.native_srid): r.deployed for r in search("").collect()}
    assert hits == {("a", None): False, ("b", "EPSG:4326"): True, ("b", "EPSG:3857"): True,
                    ("c", "EPSG:4326"): False, ("d", None): False}


def test_listing_actions(md, geo, deployments):
    out = catalog.catalog_listing(md, geo, deployments).select("locator", "action").distinct()
    assert rows(out, "locator") == [("a", "not spatial"), ("b", "view"), ("c", "create"), ("d", "not spatial")]


def test_exactly_one(md, geo):
    out = catalog.dataset_with_metadata(md, geo).select("locator", "matches", "outcome", "name")
    assert rows(out, "locator") == [("a", 0, "missing", None), ("b", 2, "multiple", None),
                                    ("c", 1, "found", "roadsxen"), ("d", 0, "missing", None)]
    with pytest.raises(Exception, match="Multiple results found for b"):
        catalog.dataset_with_metadata(md, geo, md.filter("locator = 'b'"), strict=True).collect()
    with pytest.raises(Exception, match="No geometadata found for a"):
        catalog.dataset_with_metadata(md, geo, md.filter("locator = 'a'"), strict=True).collect()


def test_live_dataset_and_servers(md, geo, deployments, servers):
    assert rows(catalog.live_dataset(md, geo, deployments).select("locator", "native_srid")) == [("b", "EPSG:4326")]
    out = catalog.deployed_servers(deployments, servers).select("locator", "deployment", "host")
    assert rows(out, "deployment") == [("b", 3, "h2"), ("b", 4, "h1")]


def test_status_order_and_killing(table, deployments, servers):
    keys = table("locator string", *[(k,) for k in "bcefz"])
    out = catalog.deployment_status(keys, deployments, servers).select("locator", "state", "status", "deployment", "host")
    assert rows(out, "locator") == [
        ("b", "live", "live", 4, "h1"), ("c", "killing", "dead", None, None), ("e", "dead", "dead", None, None),
        ("f", "starting", "starting", 6, None), ("z", "dead", "dead", None, None)]


def test_timed_out(spark, table, servers):
    dep = table("id long, locator string, server long, state string", *[(i, f"d{i}", 1, "live") for i in range(1, 6)], (6, "x", 1, "dead"))
    leases = table("id long, locator string, deployment long, lifetime string, tag string",
                   (1, "", 2, None, ""), (2, "", 3, "2020-01-01 00:00:00", ""), (3, "", 3, None, ""),
                   (4, "", 4, "2020-01-02 00:00:00", ""), (5, "", 5, "2020-01-01 00:00:00", ""), (6, "", 5, "2020-01-03 00:00:00", ""),
                   (7, "", 6, "2020-01-01 00:00:00", "")).withColumn("lifetime", F.col("lifetime").cast("timestamp"))
    now = F.lit("2020-01-02 00:00:00").cast("timestamp")  # deployment 4 ends right now: not over yet
    out = catalog.timed_out_deployments(dep, servers, leases, now)
    assert [r.id for r in out.collect()] == [3]


def test_bounds(spark, table):
    b = table("id int, x1 double, y1 double, x2 double, y2 double",
              (1, 1.0, 2.0, 1.0, 2.0), (2, 3.0, 2.0, 1.0, 2.0), (3, 180.0, 90.0, -180.0, -90.0))
    b = b.withColumn("b", make_bounds("x1", "y1", "x2", "y2")).unionByName(
        table(f"id int, x1 double, y1 double, x2 double, y2 double, b {BOX}", (4, None, None, None, None, None)))
    out = dict(rows(b.select("id", bounds_geojson("b"))))
    assert out[1] == '{"type":"Point","coordinates":[1.0,2.0]}'
    assert out[2] == '{"type":"LineString","coordinates":[[1.0,2.0],[3.0,2.0]]}'
    assert out[3].startswith('{"type":"Polygon","coordinates":[[[-180.0,-90.0],[-180.0,90.0],')
    assert out[4] is None
    assert rows(overall_extent(b, "b")) == [(-180.0, 180.0, -90.0, 90.0)]
    other = b.select(reproject_bounds("b", F.lit("EPSG:27700")).isNull().alias("n")).distinct()
    assert rows(other) == [(True,)]


def test_layer_documents_escape(table):
    d = table(f"locator string, name string, native_srid string, native_format string, native_bounds {BOX}, latlon_bounds {BOX}",
              ("ds", "a<b&c", "EPSG:4326", "zipped-shapefile", (0.0, 1.0, 2.0, 3.0), (0.0, 1.0, 2.0, 3.0)))
    doc = publish.layer_config(d, "feature").first().document
    assert "<title>a&lt;b&amp;c</title>" in doc and "<maxy>3.0</maxy>" in doc and "\n" not in doc
    assert publish.layer_config(d, "raster").count() == 0
