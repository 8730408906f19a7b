"""Map-service request logs: parameters, dataset, server, hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.plans.catalog import deployed_servers
from geoloom.plans.publish import WORKSPACE

# Services and the parameter that names the dataset in each (fixed values).
DATASET_PARAMETER = {"WCS": "COVERAGEID", "WFS": "TYPENAME", "WMS": "LAYERS"}
PREFIX = "geoserver"


def query_pairs(url: Column) -> Column:
    """`key=value` strings of the query part, in order."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.filter(F.split(query, "&"), lambda p: p != "")


def kvp(pairs: Column, name: str) -> Column:
    """Value of the last parameter with that name, whatever its case; null when absent."""
    hits = F.filter(pairs, lambda p: F.lower(F.substring_index(p, "=", 1)) == name.lower())
    last = F.try_element_at(hits, F.lit(-1))
    return F.try_url_decode(F.regexp_replace(last, r"^[^=]*=?", ""))


def ogc_service(url: Column, pairs: Column, prefix: str = PREFIX) -> Column:
    """Service of a request: its own parameter when valid, else the path; `ows` has no default."""
    path = F.regexp_extract(url, rf"^[a-z]+://[^/]+/{prefix}/(wms|wfs|wcs|ows)(?:[/?#]|$)", 1)
    asked = F.upper(kvp(pairs, "service"))
    named = F.when(asked.isin(*DATASET_PARAMETER), asked)
    return F.when(path != "", F.coalesce(named, F.when(path != "ows", F.upper(path))))


def dataset_id(service: Column, pairs: Column, workspace: str = WORKSPACE) -> tuple[Column, Column]:
    """(locator, reject reason) of a request; one of the two is null."""
    raw = F.lit(None).cast("string")
    for name, parameter in DATASET_PARAMETER.items():
        raw = F.when(service == name, kvp(pairs, parameter)).otherwise(raw)
    many = service.isin("WFS", "WMS") & raw.contains(",")
    reason = (F.when(service.isNull(), "no service").when(raw.isNull(), "no dataset")
              .when(many, "several datasets"))
    return F.when(reason.isNull(), F.regexp_replace(raw, f"^{workspace}:", "")), reason


def parse_requests(requests: DataFrame, workspace: str = WORKSPACE,
                   prefix: str = PREFIX) -> DataFrame:
    """req_id, url → service, locator and reject reason."""
    parsed = requests.withColumn("_pairs", query_pairs(F.col("url")))
    parsed = parsed.withColumn("service", ogc_service(F.col("url"), F.col("_pairs"), prefix))
    locator, reason = dataset_id(F.col("service"), F.col("_pairs"), workspace)
    return parsed.withColumn("locator", locator).withColumn("reject", reason).drop("_pairs")


def choose_server(live: DataFrame) -> DataFrame:
    """One server per locator: the one at position `1 % n`, in order of server, then deployment.

    That is the second if there are two or more, else the only one, so each partition need send
    on no more than two rows per locator.
    """
    order = Window.partitionBy("locator").orderBy("server", "deployment")
    two = live.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= 2)
    return two.groupBy("locator").agg(
        F.max_by(F.struct("server", "host", "port"), "_rn").alias("s")).select("locator", "s.*")


def route_requests(requests: DataFrame, deployments: DataFrame, servers: DataFrame,
                   workspace: str = WORKSPACE, prefix: str = PREFIX,
                   policy: str = "fixed") -> DataFrame:
    """Send each request to a server holding its dataset.

    `outcome` is routed, not found or rejected. Policy `hash` spreads the requests of a dataset
    over its servers instead of always using the same one.
    """
    parsed = parse_requests(requests, workspace, prefix)
    live = deployed_servers(deployments, servers)
    if policy == "fixed":
        routed = parsed.join(choose_server(live), "locator", "left")
    elif policy == "hash":
        # A locator's distinct servers are never more than the server table holds.
        holders = live.groupBy("locator").agg(
            F.sort_array(F.collect_set(F.struct("server", "host", "port"))).alias("_all"))
        routed = (parsed.join(holders, "locator", "left")
                  .withColumn("_s", F.col("_all")[F.expr("pmod(xxhash64(req_id), size(_all))").cast("int")])
                  .select(*parsed.columns, "_s.*"))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    target = F.concat(F.lit("http://"), "host", F.lit(":"), F.col("port").cast("string"))
    return routed.select(
        "req_id", "service", "locator", "reject", "server",
        F.when(F.col("host").isNotNull(), F.concat(
            target, F.regexp_replace("url", r"^[a-z]+://[^/?#]+", ""))).alias("target"),
        F.when(F.col("reject").isNotNull(), "rejected").when(F.col("host").isNull(), "not found")
        .otherwise("routed").alias("outcome"))


def hits_per_dataset(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("outcome") == "routed").groupBy("locator").agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("service").alias("services"))
