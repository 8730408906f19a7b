"""URL filters as of the time of fetching: dated list entries become validity intervals that captures are joined to.

Only DataFrame functions are used. A list's edits (add or remove a pattern from a day on) give intervals in which an entry
holds. Intervals are cut at the borders of time slices, and a capture meets, by an equality join on pattern and slice,
only what its slice has of its own patterns: at most one interval a day of the slice, however long a list's history
and however many captures a host has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_DAYS = 30
# Kinds of patterns, the more specific the higher.
DOMAIN, HOST, PATH, URL = 1, 2, 3, 4


def bare_url(url: Column) -> Column:
    """A URL without scheme, user, port, query and fragment; the host in lower case."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"[?#].*$", "")
    host = F.regexp_extract(rest, r"^(?:[^/@]*@)?([^/:]*)", 1)
    return F.concat(F.lower(host), F.regexp_extract(rest, r"^[^/]*(/.*)$", 1))


def patterns(url: Column, depths: Column) -> Column:
    """array<struct<kind, pattern>> of all entries that could match: the URL, its folders of the given depths, its host, the host's domains."""
    bare = bare_url(url)
    host = F.element_at(F.split(bare, "/"), 1)
    labels, folders = F.split(host, r"\."), F.split(bare, "/")
    entry = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("pattern"))
    domains = F.transform(F.when(F.size(labels) > 1, F.sequence(F.lit(1), F.size(labels) - 1)).otherwise(F.array().cast("array<int>")),
                          lambda i: entry(DOMAIN, F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    # A folder of depth i ends at the i-th slash.
    paths = F.transform(F.array_sort(F.filter(depths, lambda i: (i > 1) & (i < F.size(folders)))),
                        lambda i: entry(PATH, F.concat(F.array_join(F.slice(folders, 1, i), "/"), F.lit("/"))))
    return F.when(F.length(host) > 0, F.concat(F.array(entry(URL, bare), entry(HOST, host)), paths, domains))


def _slice(day, slice_days: int) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / slice_days).cast("long")


def validity(edits: DataFrame, until, slice_days: int = SLICE_DAYS) -> DataFrame:
    """Intervals (list, kind, pattern, since, to, slice) from edits (list, kind, pattern, action, day, seq).

    An entry holds from the day of an `add` to the day of the next `remove`, that day excluded, or to `until`; of several edits
    on one day the last by seq counts, of equal ones `remove`. Edits with a null field but seq don't count.
    """
    known = edits.dropna(subset=["list", "kind", "pattern", "day"]).filter(F.col("action").isin("add", "remove"))
    # One row a day and entry: what a window sorts is bounded by the days of the history.
    daily = known.groupBy("list", "kind", "pattern", "day").agg(F.max(F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), "action")).alias("last")).select(
        "list", "kind", "pattern", "day", (F.col("last.action") == "add").alias("on"))
    entry = Window.partitionBy("list", "kind", "pattern").orderBy("day")
    changes = daily.withColumn("was", F.lag("on").over(entry)).filter(F.col("was").isNull() | (F.col("was") != F.col("on")))
    spans = changes.withColumn("to", F.coalesce(F.lead("day").over(entry), F.lit(until).cast("date"))).filter(F.col("on") & (F.col("day") < F.col("to")))
    return spans.select("list", "kind", "pattern", F.col("day").alias("since"), "to", F.explode(
        F.sequence(_slice("day", slice_days), _slice(F.date_sub("to", 1), slice_days))).alias("slice"))


def filter_urls(captures: DataFrame, edits: DataFrame, slice_days: int = SLICE_DAYS) -> DataFrame:
    """Every capture (page_id, url, fetched) with kept, and list, kind, pattern and since of the entry that decided.

    Of the entries active on the day of fetching the most specific decides, `allow` before `block`, then the longest pattern;
    a capture without one is kept, and so is one with a null URL or day. Repeated captures stay; empty tables give no
    rows or no matches; further columns of both tables are not read.
    """
    own = captures.select(captures["page_id"].alias("page_id"), captures["url"].cast("string").alias("url"), captures["fetched"].cast("date").alias("fetched")).withColumn(
        "row", F.monotonically_increasing_id())
    # As folders only those are tried that are as deep as some entry, or a URL of very many slashes would give the square of its length.
    listed = edits.filter(F.col("kind") == PATH).agg(F.collect_set(F.size(F.split(F.col("pattern"), "/")) - 1).alias("d")).scalar()
    tried = own.withColumn("depths", listed).withColumn("slice", _slice("fetched", slice_days)).withColumn("try", F.explode_outer(patterns(F.col("url"), F.col("depths")))).select(
        "row", "page_id", "url", "fetched", "slice", F.col("try.kind").alias("kind"), F.col("try.pattern").alias("pattern"))
    last = own.agg(F.date_add(F.max("fetched"), 1).alias("day")).first()["day"]  # entries that still hold do so up to here
    found = tried.join(validity(edits, last, slice_days), ["kind", "pattern", "slice"], "left")
    active = F.col("since").isNotNull() & (F.col("since") <= F.col("fetched")) & (F.col("fetched") < F.col("to"))
    rank = F.when(active, F.struct("kind", (F.col("list") == "allow").alias("allow"), F.length("pattern").alias("size"), "list", "pattern", "since"))
    best = found.groupBy("row", "page_id", "url", "fetched").agg(F.max(rank).alias("best"))
    return best.select("page_id", "url", "fetched", F.coalesce(F.col("best.list") == "allow", F.lit(True)).alias("kept"),
                       F.col("best.list").alias("list"), F.col("best.kind").alias("kind"), F.col("best.pattern").alias("pattern"), F.col("best.since").alias("since"))
