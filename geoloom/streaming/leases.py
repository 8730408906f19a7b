"""Lease requests and grants as streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from geoloom.functions.codecs import bytes_to_hex, hex_to_bytes, split_bad
from geoloom.operators.folds import latest
from geoloom.plans.leases import finish_deployments, route_lease_requests
from geoloom.sources.tables import append_rows, read_catalog
from geoloom.sources.topics import write_topic
from geoloom.streaming.ingest import start_stage
from geoloom.streaming.jobs import STATE_STORE

# A deployment goes through the stages in this order, so their events are numbered in this order;
# within a stage, later batches have higher numbers.
STAGES = {"lease": 0, "deploy": 10 ** 12}
EVENTS_PER_BATCH = 10


def _event_no(stage: str, batch: int) -> int:
    return STAGES[stage] + (batch + 1) * EVENTS_PER_BATCH


def _current(spark, table: str, root: str, stage: str, batch: int) -> DataFrame:
    return latest(read_catalog(spark, table, root, stage, batch)).drop("event_no")


def _with_octets(messages: DataFrame) -> DataFrame:
    return messages.withColumn("tag", hex_to_bytes(F.col("tag")))


def serve_lease_requests(requests: DataFrame, table_root: str, topic_root: str | None, checkpoint: str,
                         now: Column | None = None, sink: dict | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Answer `lease-requests`: new leases and deployments into the tables, grants and deploy
    requests out, what can't be read to `lease-requests-rejected`, what no server can take to `lease-requests-unserved`. A retried batch reads the tables as they were and
    writes the same again. `sink` goes to `write_topic`, e.g. fmt="kafka" and the brokers."""
    sink = sink or {}

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen, bad = split_bad(batch.select("value"), "request_lease")
        # Of requests with one tag the least counts, so a retry takes the same. Requests carry no order of their own; the
        # tag settles which of a batch comes first.
        named = seen.withColumn("tag", bytes_to_hex(F.col("tag")))
        rest = [c for c in named.columns if c != "tag"]
        asked = named.groupBy("tag").agg(F.min(F.struct(*rest)).alias("_r")).select("tag", *[F.col("_r")[c].alias(c) for c in rest]).withColumn("seq", F.col("tag"))
        # All outputs read these, so they are worked out once.
        held = [df.persist() for df in (asked, _current(spark, "deployments", table_root, "lease", number), _current(spark, "leases", table_root, "lease", number))]
        out = route_lease_requests(
            held[0], held[1], read_catalog(spark, "servers", table_root), held[2],
            F.current_timestamp() if now is None else now, event_no=_event_no("lease", number))
        append_rows(out.leases, "leases", table_root, number, "lease")
        append_rows(out.deployments, "deployments", table_root, number, "lease")
        write_topic(_with_octets(out.grants), "lease-grants", topic_root, batch=2 * number, **sink)
        write_topic(out.deploy_requests, "deploy-requests", topic_root, batch=number, **sink)
        write_topic(_with_octets(out.unserved.drop("seq")), "lease-requests-unserved", topic_root, batch=number, **sink)
        write_topic(bad, "lease-requests-rejected", topic_root, batch=number, **sink)
        for df in held:
            df.unpersist()
    return start_stage(requests, work, checkpoint, trigger)


def serve_deploy_requests(requests: DataFrame, table_root: str, topic_root: str | None, checkpoint: str,
                          now: Column | None = None, sink: dict | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Mark finished deployments live and grant every lease that waits for them; the unreadable go to `deploy-requests-rejected`."""
    sink = sink or {}

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen, bad = split_bad(batch.select("value"), "request_deploy")
        done, grants = finish_deployments(
            seen, _current(spark, "deployments", table_root, "deploy", number),
            _current(spark, "leases", table_root, "deploy", number),
            F.current_timestamp() if now is None else now, event_no=_event_no("deploy", number))
        append_rows(done.deployments, "deployments", table_root, number, "deploy")
        append_rows(done.leases, "leases", table_root, number, "deploy")
        write_topic(_with_octets(grants), "lease-grants", topic_root, batch=2 * number + 1, **sink)
        write_topic(bad, "deploy-requests-rejected", topic_root, batch=number, **sink)
    return start_stage(requests, work, checkpoint, trigger)


def match_grants_stream(requests: DataFrame, grants: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Requests (tag, locator, arrived) with their first grant, as both streams come in.

    State is kept for `wait`, the usual lease time. Requests without a grant are never passed on; `answered_stream` reports them too.
    """
    asked = (requests.select("tag", "locator", F.col("arrived").alias("asked_at"))
             .withWatermark("asked_at", wait).dropDuplicatesWithinWatermark(["tag"]))
    given = (grants.select(F.col("tag").alias("grant_tag"), "timeout", F.col("arrived").alias("granted_at"))
             .withWatermark("granted_at", wait).dropDuplicatesWithinWatermark(["grant_tag"]))
    near = F.expr(f"granted_at between asked_at - interval {wait} and asked_at + interval {wait}")
    return asked.join(given, (F.col("tag") == F.col("grant_tag")) & near).drop("grant_tag")


class Answer(StatefulProcessor):
    """One tag: its first request and first grant by seq meet once nothing older can come; a request that has waited too long is reported without one."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getValueState("asked", "seq bigint, at bigint, locator string")
        self.given = handle.getValueState("given", "seq bigint, at bigint, timeout bigint")
        self.answered = handle.getValueState("answered", "until bigint")

    def handleInputRows(self, key, rows, timerValues):
        if self.answered.exists():  # a tag is used once
            return iter(())
        names = ["seq", "at", "locator", "is_grant", "timeout"]
        new = [row for frame in rows for row in frame[names].itertuples(index=False, name=None)]
        asked = [(int(seq), int(at), locator) for seq, at, locator, is_grant, _ in new if not is_grant]
        given = [(int(seq), int(at), None if timeout is None or timeout != timeout else int(timeout)) for seq, at, _, is_grant, timeout in new if is_grant]
        for state, found in ((self.asked, asked), (self.given, given)):
            if found:
                held = [tuple(state.get())] if state.exists() else []
                state.update(min(held + found, key=lambda row: row[:2]))
        asked, given = (tuple(s.get()) if s.exists() else None for s in (self.asked, self.given))
        for one in (asked, given):
            if one:
                self.handle.registerTimer(one[1] + self.wait_ms)
        if self.meet(asked, given):
            self.handle.registerTimer(max(asked[1], given[1]))
        return iter(())

    def meet(self, asked, given) -> bool:
        return bool(asked and given) and abs(asked[1] - given[1]) <= self.wait_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        if self.answered.exists():
            if now >= self.answered.get()[0]:
                self.answered.clear()
            return
        asked, given = (tuple(s.get()) if s.exists() else None for s in (self.asked, self.given))
        both = self.meet(asked, given) and now >= max(asked[1], given[1])
        if given and (both or now >= given[1] + self.wait_ms):
            self.given.clear()
        if asked and (both or now >= asked[1] + self.wait_ms):
            self.asked.clear()
            until = asked[1] + self.wait_ms
            if now < until:
                self.answered.update((until,))
                self.handle.registerTimer(until)
            seq, timeout = (given[0], given[2]) if both else (None, None)
            yield pd.DataFrame({"tag": [key[0]], "locator": [asked[2]], "seq": [asked[0]], "grant_timeout": pd.array([timeout], "Int64"),
                                "grant_seq": pd.array([seq], "Int64"), "granted": [bool(both)]})

    def close(self) -> None:
        pass


def answered_stream(requests: DataFrame, grants: DataFrame, delay: str = "10 minutes", wait_ms: int = 3_600_000) -> DataFrame:
    """Each request of a stream (tag, locator, seq, arrived) with the first grant of another (tag, timeout, seq, arrived), as `match_grants` has it.

    Rows may be late by `delay`. A request is passed on with its grant as soon as nothing older than the two can come, or with
    `granted` false once it has waited `wait_ms` in event time; then its state goes. Until that time a tag isn't taken again.
    Request and grant are at most `wait_ms` apart; a grant whose request never comes is forgotten after that. Rows without tag, seq or arrival are left out.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    asked = requests.select("tag", "locator", "seq", "arrived", F.lit(False).alias("is_grant"), F.lit(None).cast("bigint").alias("timeout"))
    given = grants.select("tag", F.lit(None).cast("string").alias("locator"), "seq", "arrived", F.lit(True).alias("is_grant"), F.col("timeout").cast("bigint").alias("timeout"))
    rows = asked.unionByName(given).filter("tag is not null and seq is not null and arrived is not null").withWatermark("arrived", delay)
    return rows.withColumn("at", F.unix_millis("arrived")).groupBy("tag").transformWithStateInPandas(
        Answer(wait_ms), "tag string, locator string, seq bigint, grant_timeout bigint, grant_seq bigint, granted boolean", "Append", "eventTime")
