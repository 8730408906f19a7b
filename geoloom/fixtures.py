"""Catalogue tables derived from the sample star-schema tables, for checks and benchmarks.

Each statement is plain SQL that Spark and DuckDB read alike; `{name}` marks a sample table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIT_NOW = "1996-01-01 00:00:00"

RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
       "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

DERIVED = {
    "f_metadata": """
        select doc_id as id, concat('ds-',doc_id) as locator,
               concat(source,'_',lang,'_',doc_id,'.dat') as name,
               md5(text) as checksum, n_chars as size
        from {documents}""",
    "f_geometadata": """
        select doc_id as id, concat('ds-',doc_id) as locator,
               case when doc_id%2=0 then 'EPSG:4326' else 'EPSG:3857' end as native_srid,
               case when doc_id%5=0 then 'geotiff' else 'zipped-shapefile' end as native_format,
               cast((doc_id*37%340)-170 as double) as minx,
               cast((doc_id*37%340)-170+1+doc_id%7 as double) as maxx,
               cast((doc_id*53%160)-80 as double) as miny,
               cast((doc_id*53%160)-80+1+doc_id%5 as double) as maxy
        from {documents} where doc_id%3<>0""",
    "f_servers": """
        select s_suppkey as id, concat('host',s_nationkey) as host, 8080+s_nationkey as port,
               concat('/data/',s_suppkey) as local_path,
               case when s_suppkey%4=0 then null else s_suppkey*7919%1000 end as response_time
        from {supplier}""",
    "f_deployments": """
        select o_orderkey as id, concat('ds-',o_custkey) as locator, o_custkey%100 as server,
               case when o_orderstatus='O' then 'live' when o_orderstatus='P' then 'starting'
                    when o_orderkey%2=0 then 'dead' else 'killing' end as state
        from {orders}""",
    "f_leases": """
        select l_orderkey*8+l_linenumber as id, concat('ds-',o_custkey) as locator,
               l_orderkey as deployment,
               case when l_linenumber=1 then null
                    else max(l_shipdate) + interval '1 hour' end as lifetime,
               md5(concat(l_orderkey,'-',l_linenumber)) as tag
        from {lineitem} join {orders} on l_orderkey=o_orderkey
        group by l_orderkey,l_linenumber,o_custkey""",
    "f_job_events": """
        select event_id as seq, ts, concat('job-',user_id) as id,
               case when event_type='signup' then 'pending' when event_type='view' then 'assigned'
                    when event_type='click' then 'started'
                    when event_type='purchase' then
                      (case when event_id%3=0 then 'done' else 'progress' end)
                    else (case when event_id%2=0 then 'failed' else 'aborted' end) end as status
        from {events}""",
    "f_points": """
        select event_id as id, concat('ds-',user_id) as locator, ts,
               cast(event_id*37%36000 as double)/100-180 as x,
               cast(event_id*53%18000 as double)/100-90 as y, value
        from {events}""",
    # Quarter-degree points: sums and products of the coordinates are exact in both engines.
    "f_sites": """
        select event_id as id, concat('ds-',user_id) as locator,
               cast(event_id*37%1440 as double)/4-180 as x,
               cast(event_id*53%720 as double)/4-90 as y, value
        from {events}""",
    "f_requests": """
        select doc_id as req_id, concat('http://proxy/geoserver/',
               case doc_id%4 when 0 then 'wms' when 1 then 'wfs' when 2 then 'wcs' else 'ows' end,
               '?', case when doc_id%6=0 then '' when doc_id%2=0 then 'SERVICE=WMS&'
                         else 'service=wfs&' end,
               case when doc_id%7=0 then 'layers=old&' else '' end, 'LAYERS=catalog:ds-', doc_id,
               '&typename=ds-', doc_id, case when doc_id%11=0 then ',ds-1' else '' end,
               '&CoverageId=ds-', doc_id) as url
        from {documents}""",
    # Lease requests: one per customer, in key order; locators repeat within a batch.
    "f_lease_requests": """
        select c_custkey as seq, concat('ds-',c_custkey%997) as locator,
               cast(3600000 as bigint) as timeout, md5(concat('req-',c_custkey)) as tag
        from {customer}""",
    # Diamond-shaped zones, one per spatial dataset.
    "f_zones": """
        select doc_id as id, concat('ds-',doc_id) as locator,
               cast((doc_id*37%340)-170 as double) as cx, cast((doc_id*53%160)-80 as double) as cy,
               cast(2+doc_id%4*2 as double) as r
        from {documents} where doc_id%3<>0""",
    # Archive listings: one bundle per order, one entry per line.
    "f_bundle_files": """
        select concat('bundle-',l_orderkey) as bundle,
               concat('part', case when l_orderkey%5=0 then l_linenumber%2 else 0 end,
                      case l_linenumber%4 when 0 then '.SHP' when 1 then '.dbf'
                           when 2 then '.shx' else '.shp.xml' end) as name
        from {lineitem}""",
}
# A derivation's largest table goes to tasks by this column before it is joined and grouped, so many rows to a task.
SHARED_BY = {"f_leases": ("lineitem", "l_orderkey")}
ROWS_A_TASK = 250_000
_NEEDS = {name: set(re.findall(r"\{(\w+)\}", sql)) for name, sql in DERIVED.items()}


class Tables:
    """Sample and derived tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in DERIVED:
            tables = {raw: self(raw) for raw in _NEEDS[name]}
            if name in SHARED_BY:
                raw, key = SHARED_BY[name]
                tasks = -(-tables[raw].count() // ROWS_A_TASK)
                if tasks > self.spark.sparkContext.defaultParallelism:
                    tables[raw] = tables[raw].repartition(tasks, key)
            return self.spark.sql(DERIVED[name], **tables)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        # The files carry zone-less times; the catalogue works on instants.
        return df.withColumns({field: F.col(field).cast("timestamp")
                               for field, kind in df.dtypes if kind == "timestamp_ntz"})

    def sql(self, text: str) -> DataFrame:
        """Run SQL over `{table}` placeholders, sample or derived."""
        return self.spark.sql(text, **{n: self(n) for n in set(re.findall(r"\{(\w+)\}", text))})

    def geometadata(self) -> DataFrame:
        """`f_geometadata` with its boxes as structs, the shape the catalogue functions take."""
        box = F.struct(F.col("minx").alias("minX"), F.col("maxx").alias("maxX"),
                       F.col("miny").alias("minY"), F.col("maxy").alias("maxY"))
        return self("f_geometadata").select(
            "id", "locator", "native_srid", "native_format",
            box.alias("native_bounds"), box.alias("latlon_bounds"))


def with_ctes(sql: str) -> str:
    """Prefix a query with the derivations it names, for an engine that has only the samples."""
    used = [n for n in DERIVED if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    ctes = ",\n".join(f"{n} as ({DERIVED[n].format(**{r: r for r in RAW})})" for n in used)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
