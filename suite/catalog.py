"""Catalogue lookups, publishing and request routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions.bounds import overall_extent as extent_of
from geoloom.plans import catalog, publish, requests
from suite.registry import NOW_SQL, now, query, stamp

GEOJSON = """concat('{"type":"Polygon","coordinates":[[[',minx,',',miny,'],[',minx,',',maxy,'],[',
  maxx,',',maxy,'],[',maxx,',',miny,'],[',minx,',',miny,']]]}')"""
DEPLOYED = """(select locator, bool_or(state='live') as deployed from f_deployments group by locator)"""
LIVE_DATASET = """(select m.locator, m.name, m.checksum, m.size, g.native_srid, g.native_format,
  g.minx, g.maxx, g.miny, g.maxy from f_metadata m join f_geometadata g using (locator)
  where locator in (select locator from f_deployments where state='live'))"""


@query(f"""
select m.name, m.checksum, m.size, m.locator, g.native_srid,
       case when g.locator is null then null else {GEOJSON} end as latlon_bbox,
       coalesce(d.deployed, false) as deployed
from f_metadata m left join f_geometadata g using (locator) left join {DEPLOYED} d using (locator)
where m.name like '%en%' order by m.id limit 10""")
def keyword_search(t):
    return catalog.keyword_search(t("f_metadata"), t.geometadata(), t("f_deployments"), "en")


@query(f"""
select m.name, m.checksum, m.size, m.locator, g.native_srid,
       case when g.locator is null then null else {GEOJSON} end as latlon_bbox,
       coalesce(d.deployed, false) as deployed,
       case when coalesce(d.deployed, false) then 'view' when g.native_srid is not null then 'create'
            else 'not spatial' end as action
from f_metadata m left join f_geometadata g using (locator) left join {DEPLOYED} d using (locator)""")
def catalog_listing(t):
    return catalog.catalog_listing(t("f_metadata"), t.geometadata(), t("f_deployments"))


@query("""
select m.locator, case when g.locator is null then 0 else 1 end as matches,
       case when g.locator is null then 'missing' else 'found' end as outcome,
       case when g.locator is not null then m.name end as name,
       case when g.locator is not null then m.checksum end as checksum,
       case when g.locator is not null then m.size end as size,
       g.native_srid, g.native_format, g.minx, g.maxy
from f_metadata m left join f_geometadata g using (locator)""")
def dataset_with_metadata(t):
    found = catalog.dataset_with_metadata(t("f_metadata"), t.geometadata())
    return found.select("locator", "matches", "outcome", "name", "checksum", "size", "native_srid",
                        "native_format", F.col("native_bounds.minX").alias("minx"),
                        F.col("latlon_bounds.maxY").alias("maxy"))


@query("""
select m.locator, m.name, g.native_srid, g.native_format, g.minx
from f_metadata m join f_geometadata g using (locator)""")
def described_datasets(t):
    return catalog.described(t("f_metadata"), t.geometadata()).select(
        "locator", "name", "native_srid", "native_format", F.col("native_bounds.minX").alias("minx"))


@query(f"select locator, name, checksum, size, native_srid, minx, maxx, miny, maxy from {LIVE_DATASET}")
def live_dataset(t):
    live = catalog.live_dataset(t("f_metadata"), t.geometadata(), t("f_deployments"))
    return live.select("locator", "name", "checksum", "size", "native_srid",
                       *[F.col("native_bounds")[f].alias(f.lower()) for f in ("minX", "maxX", "minY", "maxY")])


@query("""
select d.locator, d.id as deployment, d.server, s.host, s.port, s.local_path
from f_deployments d join f_servers s on d.server = s.id where d.state = 'live'""")
def deployed_servers(t):
    return catalog.deployed_servers(t("f_deployments"), t("f_servers"))


@query(f"""
with ended as (select deployment, max(lifetime) as last_end from f_leases group by deployment having max(lifetime) < {NOW_SQL})
select live.id, live.locator, host, port, local_path, strftime(last_end, '%Y-%m-%d %H:%M:%S') as lifetime
from ended join (from f_deployments where state = 'live') live on live.id = ended.deployment join f_servers on f_servers.id = live.server""")
def timed_out_deployments(t):
    return catalog.timed_out_deployments(
        t("f_deployments"), t("f_servers"), t("f_leases"), now()).withColumn("lifetime", stamp("lifetime"))


STATUS = """(
select m.locator, coalesce(d.state, 'dead') as state,
       case when d.state in ('live','starting') then d.state else 'dead' end as status,
       case when d.state in ('live','starting') then d.id end as deployment,
       case when d.state = 'live' then d.host end as host, case when d.state = 'live' then d.port end as port
from {keys} m left join (
  select d.locator, d.state, d.id, s.host, s.port, row_number() over (partition by d.locator order by
    case d.state when 'live' then 0 when 'starting' then 1 when 'killing' then 2 else 3 end, d.id desc) as rn
  from f_deployments d join f_servers s on d.server = s.id) d on d.locator = m.locator and d.rn = 1)"""


@query(f"select * from {STATUS.format(keys='f_metadata')}")
def deployment_status(t):
    return catalog.deployment_status(t("f_metadata"), t("f_deployments"), t("f_servers")).drop("local_path")


@query("""
select l.id, l.locator, strftime(l.lifetime, '%Y-%m-%d %H:%M:%S') as lifetime, s.host, s.port, s.local_path
from f_leases l join f_deployments d on l.deployment = d.id join f_servers s on d.server = s.id""")
def lease_by_id(t):
    return catalog.lease_by_id(t("f_leases"), t("f_deployments"), t("f_servers")).withColumn(
        "lifetime", stamp("lifetime"))


@query("""
select l.id, l.deployment, case when d.state = 'killing' then 'dead' else d.state end as status,
       case when d.state = 'live' then s.host end as host, case when d.state = 'live' then s.port end as port,
       case when d.state = 'live' then s.local_path end as local_path
from f_leases l join f_deployments d on l.deployment = d.id join f_servers s on d.server = s.id""")
def lease_status(t):
    return catalog.lease_status(t("f_leases"), t("f_deployments"), t("f_servers"))


@query("""
select l.id, l.deployment, strftime(l.lifetime, '%Y-%m-%d %H:%M:%S') as lifetime, l.tag
from f_leases l join f_deployments d on l.deployment = d.id where d.state = 'live'""")
def leases_of_live_deployments(t):
    live = t("f_deployments").filter(F.col("state") == "live")
    return catalog.leases_of(t("f_leases"), live).withColumn("lifetime", stamp("lifetime"))


@query("select min(minx) as minX, max(maxx) as maxX, min(miny) as minY, max(maxy) as maxY from f_geometadata")
def overall_extent(t):
    return extent_of(t.geometadata())


@query("select distinct native_srid from f_geometadata")
def distinct_crs(t):
    return catalog.distinct_crs(t.geometadata())


@query("""
select locator, case native_format when 'geotiff' then 'raster' when 'zipped-shapefile' then 'feature' end as publisher,
       case when native_format = 'geotiff' then 'raster' when size % 3 = 2 then 'polygon'
            when size % 3 = 1 then 'line' else 'point' end as symbolizer
from f_metadata join f_geometadata using (locator)""")
def publisher_and_style(t):
    rows = catalog.described(t("f_metadata"), t.geometadata())
    return rows.select("locator", publish.publisher_for(F.col("native_format")).alias("publisher"),
                       publish.symbolizer_for(F.col("native_format") == "geotiff", F.col("size") % 3).alias("symbolizer"))


def _xml_box(tag):
    return (f"'<{tag}><minx>',minx,'</minx><maxx>',maxx,'</maxx><miny>',miny,'</miny><maxy>',maxy,'</maxy></{tag}>'")


@query(f"""
select locator, concat('<coverage><name>',locator,'</name><nativeName>',locator,'</nativeName>',
  '<namespace><name>catalog</name></namespace><title>',name,'</title>',
  '<description>Generated from GeoTIFF</description><keywords><string>WCS</string><string>GeoTIFF</string><string>',
  name,'</string></keywords><srs>',native_srid,'</srs>',{_xml_box('nativeBoundingBox')},{_xml_box('latLonBoundingBox')},
  '<projectionPolicy>REPROJECT_TO_DECLARED</projectionPolicy><enabled>true</enabled>',
  '<metadata><entry key="dirName">sfdem_sfdem</entry></metadata>',
  '<store class="coverageStore"><name>sfdem</name></store><nativeFormat>GeoTIFF</nativeFormat>',
  '<defaultInterpolationMethod>nearest neighbor</defaultInterpolationMethod><requestSRS><string>',native_srid,
  '</string></requestSRS><responseSRS><string>',native_srid,'</string></responseSRS><nativeCoverageName>',
  locator,'</nativeCoverageName></coverage>') as document
from f_metadata join f_geometadata using (locator) where native_format = 'geotiff'""")
def layer_config_raster(t):
    return publish.layer_config(catalog.described(t("f_metadata"), t.geometadata()), "raster")


@query(f"""
select locator, concat('<featureType><name>',locator,'</name><nativeName>',locator,'</nativeName><title>',name,
  '</title><keywords><string>features</string><string>',name,'</string></keywords><nativeCRS>',native_srid,
  '</nativeCRS><srs>',native_srid,'</srs>',{_xml_box('nativeBoundingBox')},{_xml_box('latLonBoundingBox')},
  '<projectionPolicy>FORCE_DECLARED</projectionPolicy><enabled>true</enabled><maxFeatures>0</maxFeatures>',
  '<numDecimals>0</numDecimals><overridingServiceSRS>false</overridingServiceSRS>',
  '<skipNumberMatched>false</skipNumberMatched><circularArcPresent>false</circularArcPresent></featureType>') as document
from f_metadata join f_geometadata using (locator) where native_format = 'zipped-shapefile'""")
def layer_config_feature(t):
    return publish.layer_config(catalog.described(t("f_metadata"), t.geometadata()), "feature")


@query("""
select locator, concat('<coverageStore><name>',locator,'</name><description>',locator,'</description>',
  '<type>GeoTIFF</type><enabled>true</enabled><workspace><name>catalog</name></workspace><url>file:data/',
  locator,'</url></coverageStore>') as document
from f_metadata join f_geometadata using (locator) where native_format = 'geotiff'""")
def store_config(t):
    return publish.store_config(catalog.described(t("f_metadata"), t.geometadata()))


@query(f"""
select locator as name, name as title, concat(native_srid,',CRS:84') as crs, minx as west, maxx as east,
       miny as south, maxy as north, native_srid as native_crs, miny as native_minx, minx as native_miny,
       maxy as native_maxx, maxx as native_maxy
from {LIVE_DATASET}""")
def wms_layers(t):
    live = catalog.live_dataset(t("f_metadata"), t.geometadata(), t("f_deployments"))
    return publish.wms_layers(live).withColumn("crs", F.array_join("crs", ","))


@query(f"""
select concat('catalog:',locator) as name, name as title, 'features, states.zip' as keywords,
       native_srid as srs, minx, miny, maxx, maxy from {LIVE_DATASET}""")
def wfs_feature_types(t):
    live = catalog.live_dataset(t("f_metadata"), t.geometadata(), t("f_deployments"))
    return publish.wfs_feature_types(live)


@query(f"""
select 'WFS' as service, locator, concat('<FeatureTypeList><FeatureType><Name>catalog:',locator,'</Name><Title>',name,
  '</Title><Keywords>features, states.zip</Keywords><SRS>',native_srid,'</SRS><LatLongBoundingBox minx="',minx,
  '" miny="',miny,'" maxx="',maxx,'" maxy="',maxy,'"/></FeatureType></FeatureTypeList>') as document
from {LIVE_DATASET}
union all
select 'WMS', locator, concat('<Layer><Layer queryable="1"><Name>',locator,'</Name><Title>',name,'</Title><CRS>',
  native_srid,'</CRS><CRS>CRS:84</CRS><EX_GeographicBoundingBox><westBoundLongitude>',minx,
  '</westBoundLongitude><eastBoundLongitude>',maxx,'</eastBoundLongitude><southBoundLatitude>',miny,
  '</southBoundLatitude><northBoundLatitude>',maxy,'</northBoundLatitude></EX_GeographicBoundingBox>',
  '<BoundingBox CRS="CRS:84" minx="',minx,'" miny="',miny,'" maxx="',maxx,'" maxy="',maxy,'"/>',
  '<BoundingBox CRS="',native_srid,'" minx="',miny,'" miny="',minx,'" maxx="',maxy,'" maxy="',maxx,'"/>',
  '</Layer></Layer>')
from {LIVE_DATASET}""")
def capabilities_documents(t):
    live = catalog.live_dataset(t("f_metadata"), t.geometadata(), t("f_deployments"))
    one = [publish.capabilities_documents(live, s).select(F.lit(s).alias("service"), "locator", "document")
           for s in ("WFS", "WMS")]
    return one[0].unionByName(one[1])


PARSED = """(
select req_id, url, service, case when reject is null then regexp_replace(raw, '^catalog:', '') end as locator, reject
from (select *, case when service is null then 'no service' when raw is null then 'no dataset'
                     when service in ('WFS','WMS') and contains(raw, ',') then 'several datasets' end as reject
  from (select *, case service when 'WMS' then layers when 'WFS' then typename when 'WCS' then coverage end as raw
    from (select *, case when upper(svc) in ('WMS','WFS','WCS') then upper(svc)
                         when path <> 'ows' then upper(path) end as service
      from (select req_id, url, regexp_extract(url, '^http://proxy/geoserver/([a-z]+)\\?', 1) as path,
          substr(list_filter(pairs, lambda p: starts_with(lower(p), 'service='))[-1], 9) as svc,
          substr(list_filter(pairs, lambda p: starts_with(lower(p), 'layers='))[-1], 8) as layers,
          substr(list_filter(pairs, lambda p: starts_with(lower(p), 'typename='))[-1], 10) as typename,
          substr(list_filter(pairs, lambda p: starts_with(lower(p), 'coverageid='))[-1], 12) as coverage
        from (select req_id, url, string_split(regexp_extract(url, '\\?(.*)', 1), '&') as pairs
              from f_requests))))))"""
CHOSEN = """(select locator, server, host, port from (
  select d.locator, d.server, s.host, s.port,
         row_number() over (partition by d.locator order by d.server, d.id) - 1 as pos,
         count(*) over (partition by d.locator) as n
  from f_deployments d join f_servers s on d.server = s.id where d.state = 'live') where pos = 1 % n)"""
ROUTED = f"""(
select p.req_id, p.service, p.locator, p.reject, c.server,
       case when c.host is not null then concat('http://',c.host,':',c.port,substr(p.url, 13)) end as target,
       case when p.reject is not null then 'rejected' when c.host is null then 'not found' else 'routed' end as outcome
from {PARSED} p left join {CHOSEN} c using (locator))"""


@query(f"select req_id, service, locator, reject from {PARSED}")
def parse_requests(t):
    return requests.parse_requests(t("f_requests")).select("req_id", "service", "locator", "reject")


@query(f"select locator, server, host, port from {CHOSEN}")
def choose_server(t):
    return requests.choose_server(catalog.deployed_servers(t("f_deployments"), t("f_servers")))


@query(f"select * from {ROUTED}")
def route_requests(t):
    return requests.route_requests(t("f_requests"), t("f_deployments"), t("f_servers"))


@query(f"""
select locator, count(*) as hits, count(distinct service) as services from {ROUTED}
where outcome = 'routed' group by locator""")
def hits_per_dataset(t):
    return requests.hits_per_dataset(
        requests.route_requests(t("f_requests"), t("f_deployments"), t("f_servers")))


@query("""
select req_id, case when service = 'WMS' and version = '1.3.0' and request = 'GetCapabilities' then 'wms_capabilities'
   when service = 'WFS' and version = '1.0.0' and request = 'GetCapabilities' then 'wfs_capabilities'
   else 'servers' end as answer
from (select req_id, case req_id % 3 when 0 then 'WMS' when 1 then 'WFS' end as service,
        case when req_id % 2 = 0 then '1.3.0' else '1.0.0' end as version,
        case when req_id % 5 = 0 then 'GetMap' else 'GetCapabilities' end as request from f_requests)""")
def deployments_api(t):
    asked = t.sql("""select req_id, case req_id % 3 when 0 then 'WMS' when 1 then 'WFS' end as service,
        case when req_id % 2 = 0 then '1.3.0' else '1.0.0' end as version,
        case when req_id % 5 = 0 then 'GetMap' else 'GetCapabilities' end as request from {f_requests}""")
    return asked.select("req_id", publish.answer_kind(
        F.col("service"), F.col("version"), F.col("request")).alias("answer"))
