"""Deployment and lease workflow as appended event rows; current tables are folds of them.

A deployment event is (id, locator, server, state, event_no), a lease event
(id, locator, deployment, lifetime, tag, event_no).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.folds import assign_ids, latest, pick
from geoloom.plans.catalog import (
    dataset_with_metadata, deployment_status, timed_out_deployments)

TTL = "INTERVAL '1' HOUR"


def server_row(servers: DataFrame) -> Column:
    """The least loaded server as one struct; unknown response times last, ties by id."""
    return (servers.orderBy(F.asc_nulls_last("response_time"), "id").limit(1)
            .select(F.struct(F.col("id").alias("server"), "host", "port", "local_path")).scalar())


def best_server(servers: DataFrame) -> DataFrame:
    return servers.orderBy(F.asc_nulls_last("response_time"), "id").limit(1).select(
        "id", "host", "port", "local_path", "response_time")


def start_deployments(locators: DataFrame, deployments: DataFrame, servers: DataFrame,
                      event_no: int = 1) -> DataFrame:
    """A `starting` event per distinct locator, on the least loaded server, with a new id."""
    numbered = assign_ids(locators.select("locator").distinct(), "locator", deployments)
    return (numbered.withColumn("s", server_row(servers)).filter(F.col("s").isNotNull())
            .select("id", "locator", "s.server", F.lit("starting").alias("state"),
                    F.lit(event_no).cast("bigint").alias("event_no"),
                    "s.host", "s.port", "s.local_path"))


def transition_deployments(ids: DataFrame, deployments: DataFrame, state: str,
                           event_no: int = 1) -> DataFrame:
    """State-change events for the given deployment ids; unknown ids change nothing.

    Failed starts and finished removals go to `dead`, a removal under way to `killing`. A failed
    removal has no event: the deployment stays as it is.
    """
    return deployments.join(ids.select("id"), "id", "left_semi").select(
        "id", "locator", "server", F.lit(state).alias("state"),
        F.lit(event_no).cast("bigint").alias("event_no"))


def current_deployments(*events: DataFrame) -> DataFrame:
    return latest(_stack(events)).drop("event_no")


def current_leases(*events: DataFrame) -> DataFrame:
    return latest(_stack(events)).drop("event_no")


def _stack(tables: tuple[DataFrame, ...]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def as_events(table: DataFrame, event_no: int = 0) -> DataFrame:
    return table.withColumn("event_no", F.lit(event_no).cast("bigint"))


class Completed(NamedTuple):
    deployments: DataFrame
    leases: DataFrame


def complete_deployments(ids: DataFrame, deployments: DataFrame, leases: DataFrame, now: Column,
                         event_no: int = 1) -> Completed:
    """`live` events, and an end time one hour from now for their pending leases."""
    pending = leases.filter(F.col("lifetime").isNull()).join(
        ids.select(F.col("id").alias("deployment")), "deployment", "left_semi")
    return Completed(
        transition_deployments(ids, deployments, "live", event_no),
        pending.select("id", "locator", "deployment", (now + F.expr(TTL)).alias("lifetime"), "tag",
                       F.lit(event_no).cast("bigint").alias("event_no")))


def new_leases(requests: DataFrame, leases: DataFrame, lifetime: Column,
               event_no: int = 1) -> DataFrame:
    """Lease events for (tag, locator, deployment) rows; `tag` must be unique in the batch."""
    return assign_ids(requests.withColumn("lifetime", lifetime), "tag", leases).select(
        "id", "locator", "deployment", "lifetime", "tag",
        F.lit(event_no).cast("bigint").alias("event_no"))


def attach_leases(requests: DataFrame, leases: DataFrame, now: Column, ttl: str = TTL,
                  event_no: int = 1) -> DataFrame:
    """Leases that run from now."""
    return new_leases(requests, leases, now + F.expr(ttl), event_no)


def create_leases(requests: DataFrame, leases: DataFrame, event_no: int = 1) -> DataFrame:
    """Pending leases: the end time is set when the deployment completes."""
    return new_leases(requests, leases, F.lit(None).cast("timestamp"), event_no)


def set_lease_time(ids: DataFrame, leases: DataFrame, now: Column, event_no: int = 1) -> DataFrame:
    """New end time for leases; `ids` has `id` and `ttl_seconds`."""
    return leases.join(ids.select("id", "ttl_seconds"), "id").select(
        "id", "locator", "deployment",
        (now + F.make_dt_interval(secs=F.col("ttl_seconds"))).alias("lifetime"), "tag",
        F.lit(event_no).cast("bigint").alias("event_no"))


class Routed(NamedTuple):
    requests: DataFrame
    leases: DataFrame
    grants: DataFrame
    deploy_requests: DataFrame
    deployments: DataFrame
    unserved: DataFrame


def route_lease_requests(requests: DataFrame, deployments: DataFrame, servers: DataFrame,
                         leases: DataFrame, now: Column, mode: str = "lease",
                         event_no: int = 1) -> Routed:
    """Answer a batch of lease requests (seq, locator, timeout, tag).

    Live datasets are granted at once, starting ones get a lease only, and a dead one is started
    by its first request; the rest of the batch then finds it starting. In `attempt` mode a lease
    on a starting deployment stays pending until the deployment completes. Requests that no server can
    take, or without a locator, are `unserved`.
    """
    status = deployment_status(requests, deployments, servers).select(
        "locator", "status", F.col("deployment").alias("known"))
    dead = status.filter(F.col("status") == "dead")
    started = start_deployments(dead, deployments, servers, event_no)
    first = requests.groupBy("locator").agg(F.min("seq").alias("first_seq"))
    matched = (requests.join(status, "locator", "left").join(first, "locator", "left")
              .join(started.select("locator", F.col("id").alias("new")), "locator", "left")
              .withColumn("deployment", F.coalesce("known", "new"))
              .withColumn("outcome", F.when(F.col("status") != "dead", F.col("status"))
                          .when(F.col("seq") == F.col("first_seq"), "started")
                          .otherwise("starting")))
    routed = matched.filter(F.col("deployment").isNotNull()).select("seq", "locator", "timeout", "tag", "deployment", "outcome")
    lifetime = now + F.expr(TTL)
    if mode == "attempt":
        lifetime = F.when(F.col("outcome") == "starting", F.lit(None).cast("timestamp")).otherwise(lifetime)
    elif mode != "lease":
        raise ValueError(f"unknown mode {mode!r}")
    return Routed(
        requests=routed,
        leases=new_leases(routed, leases, lifetime, event_no),
        grants=routed.filter(F.col("outcome") == "live").select("locator", "timeout", "tag"),
        deploy_requests=started.select(
            "locator", F.col("id").alias("deployId"),
            F.struct("host", "port", F.col("local_path").alias("localPath")).alias("server")),
        deployments=started.select("id", "locator", "server", "state", "event_no"),
        unserved=matched.filter(F.col("deployment").isNull()).select("seq", "locator", "timeout", "tag"))


def grant_leases(finished: DataFrame, leases: DataFrame) -> DataFrame:
    """One grant per lease of each finished deployment (`locator`, `deployId`); timeout is 0."""
    return leases.select(F.col("deployment").alias("deployId"), "tag").join(
        finished.select("deployId", "locator"), "deployId").select(
            "locator", F.lit(0).cast("bigint").alias("timeout"), "tag")


def match_grants(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Each pending request with the first grant for its tag; `granted` is false while it waits.

    Both tables carry `seq`. A tag is used once, so only its first grant counts.
    """
    asked = pick(requests.select("tag", "locator", "seq"), ["tag"], [F.col("seq")])
    given = pick(grants.select("tag", F.col("timeout").alias("grant_timeout"),
                               F.col("seq").alias("grant_seq")), ["tag"], [F.col("grant_seq")])
    return asked.join(given, "tag", "left").withColumn("granted", F.col("grant_seq").isNotNull())


class Culled(NamedTuple):
    deployments: DataFrame
    dropped: DataFrame
    failed: DataFrame


def cull(metadata: DataFrame, geometadata: DataFrame, deployments: DataFrame, servers: DataFrame,
         leases: DataFrame, now: Column, event_no: int = 1) -> Culled:
    """Take down every timed-out deployment.

    Each one gets a `killing` and a `dead` event. Feature tables of vector datasets are dropped.
    A deployment whose dataset cannot be looked up is left alone and reported in `failed`.
    """
    expired = timed_out_deployments(deployments, servers, leases, now).select("id", "locator")
    looked = dataset_with_metadata(metadata, geometadata, expired).select(
        "locator", "outcome", "native_format")
    known = expired.join(looked, "locator")
    ok = known.filter(F.col("outcome") == "found")
    steps = F.explode(F.array(*[
        F.struct(F.lit(state).alias("state"), F.lit(event_no + i).cast("bigint").alias("event_no"))
        for i, state in enumerate(("killing", "dead"))]))
    events = (deployments.select("id", "locator", "server")
              .join(ok.select("id"), "id", "left_semi")
              .select("id", "locator", "server", steps.alias("s"))
              .select("id", "locator", "server", "s.state", "s.event_no"))
    return Culled(
        events,
        ok.filter(F.col("native_format") == "zipped-shapefile").select("locator").distinct(),
        known.filter(F.col("outcome") != "found").select("id", "locator", "outcome"))


def deploy_datasets(locators: DataFrame, metadata: DataFrame, geometadata: DataFrame,
                    deployments: DataFrame, servers: DataFrame, leases: DataFrame,
                    now: Column, event_no: int = 1) -> DataFrame:
    """Start, look up, publish and complete: the final event of each requested deployment.

    A dataset that cannot be looked up or has no publisher stays `starting`, as nothing marks it.
    """
    from geoloom.plans.publish import publisher_for

    started = start_deployments(locators, deployments, servers, event_no)
    looked = dataset_with_metadata(metadata, geometadata, locators).withColumn(
        "publisher", publisher_for(F.col("native_format")))
    ready = (F.col("outcome") == "found") & F.col("publisher").isNotNull()
    return started.join(looked.select("locator", "outcome", "publisher"), "locator", "left").select(
        "id", "locator", "server", F.when(ready, "live").otherwise("starting").alias("state"),
        (F.col("event_no") + ready.cast("int")).cast("bigint").alias("event_no"), "publisher", "outcome")


def finish_deployments(finished: DataFrame, deployments: DataFrame, leases: DataFrame,
                       now: Column, event_no: int = 1) -> tuple[Completed, DataFrame]:
    """Mark deployments live and answer every lease on them."""
    ids = finished.select(F.col("deployId").alias("id"))
    return complete_deployments(ids, deployments, leases, now, event_no), grant_leases(finished, leases)
