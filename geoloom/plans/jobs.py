"""Job log: which submissions count, which reports apply, and where each job stands.

A status report acts on a job's state like a function from old state to new state, and such
functions can be composed in any grouping. So a log is folded in blocks: the reports of a block
compose into one function, blocks compose into larger blocks, and then the state in front of each
block is handed back down. No task ever holds more than one block of a job, however long its log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.folds import pick

# Legal moves (fixed values). A job unknown so far can only become pending.
MOVES = {
    "none": ["pending"],
    "pending": ["assigned", "aborted"],
    "assigned": ["started", "aborted"],
    "started": ["progress", "done", "failed"],
    "progress": ["progress", "done", "failed"],
    "done": [],
    "failed": [],
    "aborted": [],
}
STATES = list(MOVES)
DIGITS = "".join(str(i) for i in range(len(STATES)))  # the function that changes nothing
BLOCK = 512


def can_advance(old: Column, new: Column) -> Column:
    """Whether a job in state `old` may move to `new`. Unknown names may not."""
    legal = F.lit(False)
    for state, targets in MOVES.items():
        if targets and state != "none":
            legal = legal | ((old == state) & new.isin(*targets))
    return F.coalesce(legal, F.lit(False))


def accept_submissions(submissions: DataFrame, issued: DataFrame) -> DataFrame:
    """First submission per issued id (`submissions` has id, seq); the rest are ignored."""
    first = pick(submissions, ["id"], [F.col("seq")])
    return first.join(issued.select("id").distinct(), "id", "left_semi")


def _digit(status: Column) -> Column:
    code = F.lit(None).cast("string")
    for i, name in enumerate(STATES):
        code = F.when(status == name, str(i)).otherwise(code)
    return code


def _effect(status: Column) -> Column:
    """A report as a function: digit i is the state that state i moves to."""
    out = F.lit(DIGITS)
    for i, name in enumerate(STATES):
        image = "".join(str(i) if name in MOVES[s] else str(n) for n, s in enumerate(STATES))
        out = F.when(status == name, image).otherwise(out)
    return out


def _then(first: Column, second: Column) -> Column:
    """Apply `first`, then `second`. With a single digit as `first`, the state after `second`."""
    return F.call_function("translate", first, F.lit(DIGITS), second)


def _blocks(steps: DataFrame, width: int) -> DataFrame:
    """(id, pos, fn) to (id, block, steps): ordered lists of at most `width` steps."""
    return steps.groupBy("id", F.floor(F.col("pos") / width).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "fn"))).alias("steps"))


def _composed(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(DIGITS), lambda acc, s: _then(acc, s["fn"]))


def _scan(steps: Column, start: Column) -> Column:
    """State in front of each step, given the state in front of the first."""
    seed = F.struct(start.alias("state"),
                    F.array().cast("array<struct<pos:bigint,start:string>>").alias("out"))
    return F.aggregate(steps, seed, lambda acc, s: F.struct(
        _then(acc["state"], s["fn"]).alias("state"),
        F.concat(acc["out"], F.array(F.struct(s["pos"].alias("pos"), acc["state"].alias("start")))).alias("out")))["out"]


def _starts(steps: DataFrame, levels: int, width: int) -> DataFrame:
    """(id, pos, start): the state in front of every step."""
    if levels == 0:
        whole = steps.groupBy("id").agg(
            F.sort_array(F.collect_list(F.struct("pos", "fn"))).alias("steps"))
        scanned = whole.select("id", F.explode(_scan(F.col("steps"), F.lit("0"))).alias("s"))
    else:
        blocks = _blocks(steps, width)
        above = blocks.select("id", F.col("block").alias("pos"), _composed(F.col("steps")).alias("fn"))
        given = _starts(above, levels - 1, width).withColumnRenamed("pos", "block")
        scanned = blocks.join(given, ["id", "block"]).select(
            "id", F.explode(_scan(F.col("steps"), F.col("start"))).alias("s"))
    return scanned.select("id", "s.pos", "s.start")


def _effects(events: DataFrame) -> DataFrame:
    return events.select("id", F.col("seq").cast("bigint").alias("pos"), _effect(F.col("status")).alias("fn"),
                         "status")


def job_transitions(events: DataFrame, levels: int = 3, width: int = BLOCK) -> DataFrame:
    """The reports that were applied, with the state they replaced (null for a new job).

    `events` has id, status and seq, the arrival number, unique within an id.
    """
    known = events.filter(F.col("status").isin(*STATES[1:]))
    steps = _effects(known)
    starts = _starts(steps.drop("status"), levels, width)
    moved = steps.join(starts, ["id", "pos"])
    names = F.array(*[F.lit(s) for s in STATES])
    old = names[F.col("start").cast("int")]
    legal = (can_advance(old, F.col("status"))
             | ((F.col("start") == "0") & (F.col("status") == "pending")))
    return moved.filter(legal).select(
        "id", F.col("pos").alias("seq"), F.when(F.col("start") != "0", old).alias("old_status"),
        F.col("status"))


def fold_job_status(events: DataFrame, levels: int = 3, width: int = BLOCK) -> DataFrame:
    """Final status per job; jobs never accepted are left out."""
    steps = _effects(events.filter(F.col("status").isin(*STATES[1:]))).drop("status")
    for _ in range(levels):
        steps = _blocks(steps, width).select(
            "id", F.col("block").alias("pos"), _composed(F.col("steps")).alias("fn"))
    whole = steps.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "fn"))).alias("steps"))
    names = F.array(*[F.lit(s) for s in STATES])
    final = F.substring(_composed(F.col("steps")), 1, 1)
    return whole.select("id", names[final.cast("int")].alias("status")).filter(F.col("status") != "none")


def job_status(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Current status of the asked jobs; null where the job is unknown."""
    wanted = ids.select("id").distinct()
    return wanted.join(fold_job_status(events.join(wanted, "id", "left_semi")), "id", "left")


def route_jobs(submissions: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(submissions with their service's topic, submissions naming no known service)."""
    topics = registry.select("service", "topic")
    return (submissions.join(topics, "service"),
            submissions.join(topics, "service", "left_anti"))


def as_reports(statuses: DataFrame) -> DataFrame:
    """Statuses wrapped as report requests."""
    return statuses.select(F.lit("report").alias("type"), F.struct(*statuses.columns).alias("status"))
