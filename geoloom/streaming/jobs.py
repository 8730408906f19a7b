"""Job tracking as a stream: one small state per job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from geoloom.plans.jobs import MOVES, STATES

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobFold(StatefulProcessor):
    """Keeps the status of one job, and passes on the reports that apply."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows, timer_values):
        known = self.status.get()
        state = known[0] if known else "none"
        frames = list(rows)
        if frames:
            out = []
            for seq, status in pd.concat(frames).sort_values("seq")[["seq", "status"]].itertuples(index=False):
                if status in MOVES[state]:
                    out.append((key[0], int(seq), None if state == "none" else state, status))
                    state = status
            if out:
                self.status.update((state,))
                yield pd.DataFrame(out, columns=["id", "seq", "old_status", "status"])

    def close(self) -> None:
        pass


def job_transitions_stream(events: DataFrame) -> DataFrame:
    """Applied reports of a stream of (id, seq, status). Needs the RocksDB state store."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return events.select("id", "seq", "status").groupBy("id").transformWithStateInPandas(
        JobFold(), "id string, seq bigint, old_status string, status string", "Append", "none")


def _plain(value):
    """A value of a pandas row as the state stores take it."""
    if value is None or value != value:
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value.item() if hasattr(value, "item") else value


class OrderedFold(StatefulProcessor):
    """Reports of one job wait until the watermark has passed them, are applied in order, and the job is forgotten a while after its end.

    The list of those that wait holds what arrives in the watermark's delay, whatever the length of the job's log.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string, changed bigint")
        self.waiting = handle.getListState("waiting", "at bigint, seq bigint, status string")

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(at), int(seq), status) for frame in rows for at, seq, status in frame[["at", "seq", "status"]].itertuples(index=False)]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(at for at, *_ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        state, changed = self.status.get() if self.status.exists() else ("none", 0)
        waiting = sorted(tuple(row) for row in self.waiting.get()) if self.waiting.exists() else []
        due = [row for row in waiting if row[0] <= now]
        later, out = waiting[len(due):], []
        ended = lambda: state != "none" and not MOVES[state]
        for at, seq, status in due:
            if ended() and at >= changed + self.keep_ms:
                state = "none"
            if status in MOVES[state]:
                out.append((key[0], seq, None if state == "none" else state, status))
                state, changed = status, at
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0])
        elif due:
            self.waiting.clear()
        if state == "none" or ended() and now >= changed + self.keep_ms:
            self.status.clear()
        else:
            self.status.update((state, changed))
            if ended():
                self.handle.registerTimer(changed + self.keep_ms)
        if out:
            yield pd.DataFrame(out, columns=["id", "seq", "old_status", "status"])

    def close(self) -> None:
        pass


def ordered_transitions_stream(events: DataFrame, wait: str = "10 minutes", keep_ms: int = 86_400_000) -> DataFrame:
    """Applied reports of a stream of (id, ts, seq, status) whose rows come out of order: those of `job_transitions` in the order of (ts, seq).

    A report is passed on once nothing older can come, `wait` after it in event time; one that comes later than that is dropped
    by the watermark. Unknown names and nulls are no reports. A job that has ended is forgotten `keep_ms` after its last change:
    an id must not be used again before its reports of old have stopped.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    known = events.filter(F.col("status").isin(*STATES[1:]) & F.col("id").isNotNull() & F.col("ts").isNotNull())
    return known.withWatermark("ts", wait).select("id", "ts", F.unix_millis("ts").alias("at"), "seq", "status").groupBy("id").transformWithStateInPandas(
        OrderedFold(keep_ms), "id string, seq bigint, old_status string, status string", "Append", "eventTime")


class FirstUse(StatefulProcessor):
    """One issued id: its first submission by seq is passed on once nothing older can come; every later one is refused for good."""

    def __init__(self, schema, names: list[str]):
        self.schema, self.names = schema, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.issued = handle.getValueState("issued", "used boolean")
        self.best = handle.getValueState("best", self.schema)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.issued.update((False,))

    def handleInputRows(self, key, rows, timerValues):
        frames = [frame for frame in rows if len(frame)]  # an id without submissions so far brings none
        if frames and self.issued.exists() and not self.issued.get()[0]:
            # By position: Spark renames some columns on the way. The last one is the time in milliseconds.
            values = [tuple(map(_plain, row)) for frame in frames for row in frame.itertuples(index=False, name=None)]
            at = self.names.index("seq")
            held = [tuple(self.best.get())] if self.best.exists() else []
            self.best.update(min(held + [row[:-1] for row in values], key=lambda row: row[at]))
            self.handle.registerTimer(min(row[-1] for row in values))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.best.exists():
            row = tuple(self.best.get())
            self.best.clear()
            self.issued.update((True,))
            yield pd.DataFrame([row], columns=self.names)

    def close(self) -> None:
        pass


def first_submissions_stream(submissions: DataFrame, issued: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """The first submission by seq of each issued id, of a stream of (id, seq, arrived, …) whose rows come out of order.

    State starts from `issued`, a table as of the stream's start, and keeps one flag an id for good, so a used id is refused however
    much later it comes. A submission is passed on `wait` after its arrival in event time. Ids that were never issued are left
    out, and so are rows without id, seq or arrival.
    """
    submissions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = submissions.filter(F.col("id").isNotNull()).filter("arrived is not null and seq is not null").withWatermark("arrived", wait)
    rows = rows.select("*", F.unix_millis("arrived"))
    return rows.groupBy("id").transformWithStateInPandas(
        FirstUse(submissions.schema, submissions.columns), submissions.schema, "Append", "eventTime",
        issued.select("id").filter(F.col("id").isNotNull()).distinct().groupBy("id"))


def accept_submissions_stream(submissions: DataFrame, issued: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Any first submission per issued id (id, arrived, …) of a stream, at once, forgotten after `wait`; `first_submissions_stream` keeps to seq and forgets none."""
    return (submissions.withWatermark("arrived", wait).dropDuplicatesWithinWatermark(["id"])
            .join(issued.select("id").distinct(), "id", "left_semi"))


def status_reports(transitions: DataFrame) -> DataFrame:
    """Applied changes wrapped as reports, to be published."""
    return transitions.select(F.lit("report").alias("type"), F.struct("id", "status").alias("status"))
