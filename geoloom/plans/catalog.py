"""Catalogue queries over metadata, geometadata, servers, deployments and leases.

Small tables are joined without a hint: the planner broadcasts them when their size allows and
shuffles otherwise. Lookups take a DataFrame of keys, so many lookups are one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.bounds import bounds_geojson
from geoloom.operators.folds import exactly_one, pick

SEARCH_LIMIT = 10


def live_flags(deployments: DataFrame) -> DataFrame:
    """Per locator, whether any deployment is live."""
    return deployments.groupBy("locator").agg(
        F.bool_or(F.col("state") == "live").alias("deployed"))


def row_action() -> Column:
    """What a search row offers: open the live layer, create one, or nothing."""
    return (F.when(F.col("deployed"), "view")
            .when(F.col("native_srid").isNotNull(), "create")
            .otherwise("not spatial"))


def _hit_columns() -> list[Column]:
    return [F.col("name"), F.col("checksum"), F.col("size"), F.col("locator"),
            F.col("native_srid"), bounds_geojson("latlon_bounds").alias("latlon_bbox"),
            F.coalesce("deployed", F.lit(False)).alias("deployed")]


def keyword_search(metadata: DataFrame, geometadata: DataFrame, deployments: DataFrame,
                   keyword: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The first `limit` datasets by id whose name contains the keyword (`%` and `_` are wild).

    The left joins keep every metadata row, so the first `limit` rows of metadata are enough; the
    other tables are then cut down to those few locators before they are joined.
    """
    # The limit goes first, so the hits are at most `limit` rows and may be broadcast.
    hits = (metadata.filter(F.col("name").like(f"%{keyword}%"))
            .select("id", "name", "checksum", "size", "locator").orderBy("id").limit(limit))
    wanted = F.broadcast(hits.select("locator").distinct())
    boxes = geometadata.join(wanted, "locator", "left_semi").select(
        "locator", F.col("id").alias("gid"), "native_srid", "latlon_bounds")
    live = live_flags(deployments.join(wanted, "locator", "left_semi"))
    return (hits.join(boxes, "locator", "left").join(live, "locator", "left")
            .orderBy("id", F.asc_nulls_last("gid")).limit(limit).select(*_hit_columns()))


def catalog_listing(metadata: DataFrame, geometadata: DataFrame,
                    deployments: DataFrame) -> DataFrame:
    """Every dataset as a search row, with the action it offers."""
    return (metadata.join(geometadata.drop("id"), "locator", "left")
            .join(live_flags(deployments), "locator", "left")
            .select(*_hit_columns()).withColumn("action", row_action()))


def described(metadata: DataFrame, geometadata: DataFrame) -> DataFrame:
    """Inner join of the two metadata tables; a locator's rows multiply."""
    return metadata.select("locator", "name", "checksum", "size").join(
        geometadata.drop("id"), "locator")


def dataset_with_metadata(metadata: DataFrame, geometadata: DataFrame,
                          locators: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Both metadata records per locator, with how many pairs matched.

    `outcome` is found, missing or multiple; only a found row carries values. With `strict` the
    other outcomes are errors. Each side is reduced to one row per locator before the join, so a
    locator with many rows on both sides never multiplies.
    """
    left = exactly_one(metadata.select("locator", "name", "checksum", "size"), ["locator"])
    right = exactly_one(geometadata.drop("id"), ["locator"]).withColumnRenamed("matches", "gmatches")
    keys = (locators if locators is not None else metadata).select("locator").distinct()
    out = (keys.join(left, "locator", "left").join(right, "locator", "left")
           .withColumn("matches", F.coalesce(F.col("matches") * F.col("gmatches"), F.lit(0)))
           .drop("gmatches"))
    outcome = (F.when(F.col("matches") == 1, "found").when(F.col("matches") == 0, "missing")
               .otherwise("multiple"))
    if strict:
        outcome = F.when(F.col("matches") == 1, "found").otherwise(F.raise_error(F.concat(
            F.when(F.col("matches") == 0, "No geometadata found for ")
            .otherwise("Multiple results found for "), F.col("locator"))).cast("string"))
    values = [c for c in out.columns if c not in ("locator", "matches")]
    found = F.col("matches") == 1
    return out.select("locator", "matches", outcome.alias("outcome"),
                      *[F.when(found, F.col(c)).alias(c) for c in values])


def live_dataset(metadata: DataFrame, geometadata: DataFrame, deployments: DataFrame,
                 locators: DataFrame | None = None) -> DataFrame:
    """At most one described dataset per locator that has a live deployment (lowest ids win)."""
    live = deployments.filter(F.col("state") == "live").select("locator")
    if locators is not None:
        live = live.join(locators.select("locator"), "locator", "left_semi")
    md = pick(metadata, ["locator"], [F.col("id")]).drop("id")
    geo = pick(geometadata, ["locator"], [F.col("id")]).drop("id")
    return md.join(geo, "locator").join(live, "locator", "left_semi")


def _with_server(deployments: DataFrame, servers: DataFrame) -> DataFrame:
    """Deployments with their server's address; those without a known server drop out."""
    srv = servers.select(F.col("id").alias("server"), "host", "port", "local_path")
    return deployments.join(srv, "server")


def deployed_servers(deployments: DataFrame, servers: DataFrame,
                     locators: DataFrame | None = None) -> DataFrame:
    """Servers of every live deployment, one row per deployment."""
    live = deployments.filter(F.col("state") == "live")
    if locators is not None:
        live = live.join(locators.select("locator").distinct(), "locator", "left_semi")
    return _with_server(live, servers).select(
        "locator", F.col("id").alias("deployment"), "server", "host", "port", "local_path")


def timed_out_deployments(deployments: DataFrame, servers: DataFrame, leases: DataFrame,
                          now: Column) -> DataFrame:
    """Live deployments whose newest lease has ended.

    A deployment with no lease, or only pending ones, has no newest lifetime and stays.
    """
    newest = (leases.filter(F.col("lifetime").isNotNull()).groupBy("deployment")
              .agg(F.max("lifetime").alias("lifetime")).filter(F.col("lifetime") < now))
    live = deployments.filter(F.col("state") == "live")
    return (_with_server(live, servers)
            .join(newest, F.col("id") == F.col("deployment"))
            .select("id", "locator", "host", "port", "local_path", "lifetime"))


STATE_RANK = {"live": 0, "starting": 1, "killing": 2, "dead": 3}


def _rank(state: str = "state") -> Column:
    rank = F.lit(len(STATE_RANK))
    for name, value in STATE_RANK.items():
        rank = F.when(F.col(state) == name, value).otherwise(rank)
    return rank


def deployment_status(locators: DataFrame, deployments: DataFrame,
                      servers: DataFrame) -> DataFrame:
    """Status per locator: live before starting before killing before dead, newest id first.

    A locator with no deployment is dead. `state` shows killing; `status` counts it as dead.
    """
    best = (_with_server(deployments, servers).groupBy("locator").agg(F.min_by(
        F.struct("id", "state", "host", "port", "local_path"),
        F.struct(_rank(), -F.col("id"))).alias("d")))
    state = F.coalesce(F.col("d.state"), F.lit("dead"))
    status = F.when(state == "killing", "dead").otherwise(state)
    active, live = status != "dead", status == "live"
    return (locators.select("locator").distinct().join(best, "locator", "left").select(
        "locator", state.alias("state"), status.alias("status"),
        F.when(active, F.col("d.id")).alias("deployment"),
        *[F.when(live, F.col(f"d.{c}")).alias(c) for c in ("host", "port", "local_path")]))


def lease_by_id(leases: DataFrame, deployments: DataFrame, servers: DataFrame,
                ids: DataFrame | None = None) -> DataFrame:
    """Locator, end time and server address of leases."""
    wanted = leases if ids is None else leases.join(ids.select("id"), "id", "left_semi")
    hosts = _with_server(deployments, servers).select(
        F.col("id").alias("deployment"), "host", "port", "local_path")
    return wanted.select("id", "locator", "lifetime", "deployment").join(
        hosts, "deployment").drop("deployment")


def lease_status(leases: DataFrame, deployments: DataFrame, servers: DataFrame,
                 ids: DataFrame | None = None) -> DataFrame:
    """State of the deployment behind each lease."""
    wanted = leases if ids is None else leases.join(ids.select("id"), "id", "left_semi")
    known = _with_server(deployments, servers).select(
        F.col("id").alias("deployment"), "state", "host", "port", "local_path")
    live = F.col("state") == "live"
    return wanted.select("id", "deployment").join(known, "deployment").select(
        "id", "deployment", F.when(F.col("state") == "killing", "dead")
        .otherwise(F.col("state")).alias("status"),
        *[F.when(live, F.col(c)).alias(c) for c in ("host", "port", "local_path")])


def leases_of(leases: DataFrame, deployments: DataFrame) -> DataFrame:
    """All leases of the given deployments (`deployments.id`)."""
    return leases.join(deployments.select(F.col("id").alias("deployment")), "deployment").select(
        "id", "deployment", "lifetime", "tag")


def distinct_crs(geometadata: DataFrame) -> DataFrame:
    return geometadata.select("native_srid").distinct()
