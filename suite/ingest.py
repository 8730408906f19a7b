"""Messages, uploads and inspection."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import bounds, codecs
from geoloom.operators import folds, inspection
from geoloom.schemas import DEPLOYMENT_STATES
from suite.registry import NOW_SQL, now, query, stamp

# The md5 of a text stands in for a checksum; as a message it is an array of signed bytes.
MESSAGES = """
select doc_id as seq, 'uploads' as topic, concat('{{"name":"', source, '","locator":"ds-', doc_id, '"}}') as value from {documents}
union all select doc_id, 'metadata', case when doc_id % 2 = 0
  then concat('{{"name":"', source, '","locator":"ds-', doc_id, '","checksum":[-44,29,', doc_id % 128, '],"size":', n_chars, '}}')
  else concat('{{"locator":"ds-', doc_id, '","crsCode":"EPSG:4326","nativeBoundingBox":{{"minX":0,"maxX":', doc_id,
    ',"minY":0,"maxY":1}},"latitudeLongitudeBoundingBox":{{"minX":0,"maxX":2,"minY":0,"maxY":1}},"nativeFormat":"geotiff"}}') end
  from {documents}
union all select doc_id, 'metadata', case doc_id % 3 when 0 then '{{"broken":' when 1 then concat('{{"locator":"ds-', doc_id, '"}}') end from {documents}
union all select doc_id, 'other', concat('raw-', doc_id) from {documents}
""".replace("{{", "{").replace("}}", "}")
SPARK_MESSAGES = MESSAGES.replace("{documents}", "documents")


def _messages(t):
    # The text holds braces, so the table goes in by name, not by format field.
    t("documents").createOrReplaceTempView("documents_for_messages")
    return t.spark.sql(SPARK_MESSAGES.replace("from documents", "from documents_for_messages"))


M = "(" + SPARK_MESSAGES + ")"


@query(f"""
select doc_id as seq, 'metadata' as kind, source as name, concat('ds-', doc_id) as locator,
   concat('d41d', printf('%02x', doc_id % 128)) as detail, n_chars as number
from documents where doc_id % 2 = 0
union all select doc_id, 'geometadata', 'geotiff', concat('ds-', doc_id), 'EPSG:4326', doc_id from documents where doc_id % 2 = 1
union all select doc_id, 'neither', null, null, case doc_id % 3 when 0 then '{{"broken":' when 1
  then concat('{{"locator":"ds-', doc_id, '"}}') end, null from documents""")
def split_metadata(t):
    md, geo, rest = codecs.split_metadata(_messages(t).filter("topic = 'metadata'"))
    none = F.lit(None)
    return (md.select("seq", F.lit("metadata").alias("kind"), "name", "locator",
                      codecs.bytes_to_hex(F.col("checksum")).alias("detail"), F.col("size").alias("number"))
            .unionByName(geo.select("seq", F.lit("geometadata").alias("kind"), F.col("nativeFormat").alias("name"),
                                    "locator", F.col("crsCode").alias("detail"),
                                    F.col("nativeBoundingBox.maxX").cast("bigint").alias("number")))
            .unionByName(rest.select("seq", F.lit("neither").alias("kind"), none.cast("string").alias("name"),
                                     none.cast("string").alias("locator"), F.col("value").alias("detail"),
                                     none.cast("bigint").alias("number"))))


@query(f"""
select seq, topic, case when topic = 'uploads' then value
  when value like '%checksum%' then value
  when value like '%crsCode%' then replace(replace(replace(value, ':0,', ':0.0,'), ':1}}', ':1.0}}'),
     concat('"maxX":', seq, ','), concat('"maxX":', seq, '.0,'))
  else upper(hex(encode(value))) end as body
from (select seq, topic, replace(value, '"latitudeLongitudeBoundingBox":{{"minX":0,"maxX":2,', '"latitudeLongitudeBoundingBox":{{"minX":0,"maxX":2.0,') as value
from {M})""")
def decode_any(t):
    return codecs.decode_any(_messages(t)).select("seq", "topic", "body")


@query(f"""
select 'good' as kind, seq, source as detail from (select doc_id as seq, source from documents)
union all select 'good', doc_id, source from documents where doc_id % 2 = 0
union all select 'bad', seq, case when value is null then 'no value' when value like '%broken%' or topic = 'other' then 'not json'
   else 'missing field' end from {M}
where topic <> 'uploads' and (value is null or value not like '%checksum%')""")
def split_bad(t):
    good, bad = codecs.split_bad(_messages(t), "upload")
    return good.select(F.lit("good").alias("kind"), "seq", F.col("name").alias("detail")).unionByName(
        bad.select(F.lit("bad").alias("kind"), "seq", F.col("reason").alias("detail")))


@query("""
select o_orderkey as id, case o_orderstatus when 'O' then 'live' when 'P' then 'starting' else 'dead' end as status,
       case when o_orderstatus <> 'F' then o_orderkey end as deployment,
       case when o_orderstatus = 'O' then concat('host', o_custkey % 25) end as host from orders""")
def deploy_status_codec(t):
    """Encode statuses, decode them again; a dead one carries no fields."""
    rows = t.sql("""select o_orderkey as id, case o_orderstatus when 'O' then 'live' when 'P' then 'starting'
        else 'dead' end as status, concat('host', o_custkey % 25) as host from {orders}""")
    server = F.when(F.col("status") == "live", F.struct(
        "host", F.lit(8080).alias("port"), F.lit("/data").alias("localPath")))
    sent = rows.select("id", codecs.encode(F.struct(
        "status", F.when(F.col("status") != "dead", F.col("id")).alias("id"), server.alias("server"))).alias("value"))
    return codecs.decode(sent, "deploy_status", strict=True).select(
        "id", "record.status", F.col("record.id").alias("deployment"), "record.server.host")


@query("""
select seq, id, status, case when status = 'pending' then concat('svc-', seq % 3) end as service,
       case when status = 'pending' then 2 end as n_params, case when status = 'progress' then seq / 1e6 end as progress
from f_job_events""")
def job_status_codec(t):
    """Both wire shapes of a pending task, flat and nested, decode alike."""
    e = t("f_job_events")
    svc = F.concat(F.lit("svc-"), (F.col("seq") % 3).cast("string"))
    params = F.array(F.col("id"), F.lit("0.1"))
    pending, flat = F.col("status") == "pending", F.col("seq") % 2 == 0
    record = F.struct(
        "status", "id", F.when(pending & flat, svc).alias("serviceName"),
        F.when(pending & flat, params).alias("params"),
        F.when(pending & ~flat, F.struct(svc.alias("service"), params.alias("parameters"))).alias("task"),
        F.when(F.col("status").isin("assigned", "started"), F.lit("node")).alias("node"),
        F.when(F.col("status") == "progress", F.col("seq") / 1e6).alias("progress"),
        F.when(F.col("status") == "done", F.lit("r")).alias("result"),
        F.when(F.col("status") == "failed", F.lit("why")).alias("reason"))
    out = codecs.decode(e.select("seq", codecs.encode(record).alias("value")), "job_status", strict=True)
    return out.select("seq", "record.id", "record.status", F.col("record.serviceName").alias("service"),
                      F.when(F.col("record.params").isNotNull(), F.size("record.params")).alias("n_params"),
                      "record.progress")


@query("""
select seq, case when seq % 3 = 0 then 'submit' else 'report' end as type,
       case when seq % 3 = 0 then id end as id, case when seq % 3 <> 0 then id end as status_id from f_job_events""")
def job_request_codec(t):
    """The tag is read from `type` or `tag`."""
    e = t("f_job_events")
    submit, tagged = F.col("seq") % 3 == 0, F.col("seq") % 2 == 0
    kind = F.when(submit, "submit").otherwise("report")
    record = F.struct(
        F.when(tagged, kind).alias("tag"), F.when(~tagged, kind).alias("type"),
        F.when(submit, F.col("id")).alias("id"), F.when(submit, F.lit("simplify")).alias("service"),
        F.when(submit, F.array(F.lit("a"))).alias("parameters"),
        F.when(~submit, F.struct(F.lit("aborted").alias("status"), "id")).alias("status"))
    out = codecs.decode(e.select("seq", codecs.encode(record).alias("value")), "job_request", strict=True)
    return out.select("seq", "record.type", "record.id", F.col("record.status.id").alias("status_id"))


@query("""
select id, tag, case when lifetime is not null then concat(strftime(lifetime, '%Y-%m-%d %H:%M:%S'), '.0') end as lifetime,
   tag as round_trip from f_leases""")
def lease_codec(t):
    """Tags as signed bytes on the wire and hex in tables; end times as text."""
    lease = t("f_leases")
    sent = lease.select("tag", codecs.encode(F.struct(
        "id", "deployment", codecs.write_stamp(F.col("lifetime")).alias("lifetime"),
        codecs.hex_to_bytes(F.col("tag")).alias("tag"))).alias("value"))
    out = codecs.decode(sent, "lease", strict=True)
    return out.select("record.id", "tag", codecs.write_stamp(codecs.read_stamp(F.col("record.lifetime"))).alias("lifetime"),
                      codecs.bytes_to_hex(F.col("record.tag")).alias("round_trip"))


@query("""
select source as name, concat('ds-', doc_id) as locator, md5(text) as checksum, octet_length(encode(text)) as size, null as reason
from documents where doc_id % 10 <> 0
union all select source, concat('ds-', doc_id), null, null, 'no such blob' from documents where doc_id % 10 = 0""")
def extract_metadata(t):
    """Texts as files: one upload each, every tenth file missing."""
    docs = t("documents")
    uploads = docs.select(F.col("source").alias("name"), F.concat(F.lit("ds-"), "doc_id").alias("locator"))
    body = F.col("text").cast("binary")
    blobs = docs.filter(F.col("doc_id") % 10 != 0).select(
        F.concat(F.lit("ds-"), "doc_id").alias("locator"), F.length(body).cast("bigint").alias("length"), body.alias("content"))
    good, bad = inspection.extract_metadata(uploads, blobs)
    none = F.lit(None)
    return good.withColumn("reason", none.cast("string")).unionByName(bad.select(
        "name", "locator", none.cast("string").alias("checksum"), none.cast("bigint").alias("size"), "reason"))


@query("""
select doc_id, case doc_id % 4 when 0 then 'geotiff' when 1 then 'geotiff' when 2 then 'zip' end as format from documents""")
def classify_format(t):
    """Texts behind four different leading byte sequences."""
    heads = ["49492A00", "4D4D002A", "504B0304", "25504446"]
    head = F.unhex(F.array(*[F.lit(h) for h in heads])[(F.col("doc_id") % 4).cast("int")])
    return t("documents").select("doc_id", inspection.classify_format(
        F.concat(head, F.col("text").cast("binary"))).alias("format"))


@query("""
select bundle, count(*) as entries, count(distinct regexp_replace(name, '\\..*$', '')) = 1 as one_base,
       bool_or(lower(name) like '%.shp') as has_shape,
       count(distinct regexp_replace(name, '\\..*$', '')) = 1 and bool_or(lower(name) like '%.shp') as valid
from f_bundle_files group by bundle""")
def validate_bundles(t):
    return inspection.validate_bundles(t("f_bundle_files"))


BOX = """(select locator, min(x) as minx, max(x) as maxx, min(y) as miny, max(y) as maxy from f_points group by locator)"""


@query(f"select locator, 'EPSG:4326' as native_srid, minx, maxx, miny, maxy, minx as lonx from {BOX}")
def dataset_bounds(t):
    out = inspection.dataset_bounds(t("f_points"))
    b = F.col("native_bounds")
    return out.select("locator", "native_srid", *[b[f].alias(f.lower()) for f in ("minX", "maxX", "minY", "maxY")],
                      F.col("latlon_bounds.minX").alias("lonx"))


@query("""
select id, round(minx * pi() / 180 * 6378137.0, 3) as minx, round(maxx * pi() / 180 * 6378137.0, 3) as maxx,
  round(ln(tan(pi() / 4 + miny * pi() / 360)) * 6378137.0, 3) as miny,
  round(ln(tan(pi() / 4 + maxy * pi() / 360)) * 6378137.0, 3) as maxy, maxy as back
from (select id, minx, maxx, miny, least(maxy, 85.05112877980659) as maxy from f_geometadata)""")
def reproject_bounds(t):
    """To web mercator and back."""
    moved = t.geometadata().withColumn("m", bounds.reproject_bounds("native_bounds", F.lit("EPSG:4326"), "EPSG:3857"))
    back = bounds.reproject_bounds("m", F.lit("EPSG:3857"))
    return moved.select("id", *[F.round(F.col("m")[f], 3).alias(f.lower()) for f in ("minX", "maxX", "minY", "maxY")],
                        F.round(back["maxY"], 9).alias("back"))


@query("""
select id, case when id % 4 = 0 then concat('{"type":"Point","coordinates":[', minx, ',', miny, ']}')
  when id % 4 = 1 then concat('{"type":"LineString","coordinates":[[', minx, ',', miny, '],[', maxx, ',', miny, ']]}')
  else concat('{"type":"Polygon","coordinates":[[[',minx,',',miny,'],[',minx,',',maxy,'],[',maxx,',',maxy,'],[',
     maxx,',',miny,'],[',minx,',',miny,']]]}') end as geojson from f_geometadata""")
def bounds_geojson(t):
    """Flat boxes become points and lines; corners may come in either order."""
    x2 = F.when(F.col("id") % 4 == 0, F.col("minx")).otherwise(F.col("maxx"))
    y2 = F.when(F.col("id") % 4 < 2, F.col("miny")).otherwise(F.col("maxy"))
    return t("f_geometadata").select("id", bounds.bounds_geojson(
        bounds.make_bounds(x2, y2, F.col("minx"), F.col("miny"))).alias("geojson"))


@query("""
select c_custkey as key, (select max(id) from f_metadata) + row_number() over (order by md5(cast(c_custkey as varchar)), c_custkey) as id
from customer""")
def assign_ids(t):
    return folds.assign_ids(t("customer").select(F.col("c_custkey").alias("key")), "key", t("f_metadata"))


@query("""
select g.id, g.native_srid, case when n_nationkey % 3 = 0 then 'EPSG:4326' when n_nationkey % 3 = 1 then 'EPSG:3857' end as code
from f_geometadata g join nation on g.id % 30 = n_nationkey
union all select id, native_srid, null from f_geometadata where id % 30 >= 25""")
def crs_code(t):
    systems = t.sql("""select n_nationkey as crs_name, case n_nationkey % 3 when 0 then 'EPSG:4326'
        when 1 then 'EPSG:3857' end as code from {nation}""")
    named = t("f_geometadata").select("id", "native_srid", (F.col("id") % 30).alias("crs_name"))
    return inspection.crs_code(named, systems).drop("crs_name")


@query("""
select id, state, state is null or state in ('starting','live','killing','dead') as ok
from (select id, case when id % 10 = 0 then 'unknown' when id % 10 = 1 then null else state end as state from f_deployments)""")
def check_states(t):
    rows = t("f_deployments").select("id", F.when(F.col("id") % 10 == 0, "unknown").when(
        F.col("id") % 10 != 1, F.col("state")).alias("state"))
    good, bad = inspection.check_states(rows, DEPLOYMENT_STATES)
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))
