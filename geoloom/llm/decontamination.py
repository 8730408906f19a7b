"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders that keep their value aside; a name is a capitalised word after a word that
ends no sentence, a unit a known word after a number. Windows of canonical words are hashed and joined. The hits of a
row and an item at one distance of their positions are a match; its slots are consistent if no value of the item both stays and
gives way to another, so a question asked anew with other numbers or names is caught, also where a value that has two
places in it is replaced by two, and chance fits of placeholders are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.session import checkpointed

WINDOW = 8  # words, a power of two
LITERALS = 5  # words of a window at least that aren't placeholders
EVIDENCE = 16  # letters and digits of a whole short item; one of fewer counts only where it is all of the text
BROADCAST_FOUND = 200_000  # digests of texts that hold an item, up to this number sent to all tasks, 20 MB; more are joined by a shuffle
BROADCAST_WINDOWS = 500_000  # benchmark windows up to this number are sent to all tasks, 10 MB; more are joined by a shuffle
# Units that may follow a number.
UNITS = ("km m cm mm mi miles mile ft feet foot inch inches yards kg g mg lb lbs pounds pound oz ounces tons l ml liters litres liter litre gallons "
         "s sec seconds second min minutes minute h hr hours hour days day weeks week months month years year mph kmh percent dollars dollar cents "
         "euros euro usd eur degrees degree celsius fahrenheit kelvin mol hz khz mhz ghz v volts volt w watts watt kw j joules joule n pa bits bytes kb mb gb tb")
_UNIT = "|".join(UNITS.split())


def marked_words(text: Column) -> Column:
    """The words of a text, lower-cased, without punctuation; placeholders as <num>=value, <name>=value, <unit>=value."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "[<>=\\s]+", " ")
    text = F.regexp_replace(text, " (?<=[\\p{Ll}\\p{Nd},;:] )(\\p{Lu}\\p{L}*)", " <name>=$1")
    text = F.regexp_replace(text, "(^| )[^\\p{L}\\p{Nd} ]*([0-9]+(?:[.,:/][0-9]+)*)(?: ?(%|" + _UNIT + ")(?![\\p{L}\\p{Nd}]))?", "$1<num>=$2 <unit>=$3 ")
    text = F.replace(text, F.lit("<unit>= "), F.lit(" "))
    text = F.lower(F.regexp_replace(text, "[^\\p{L}\\p{M}\\p{Nd}<>=.% ]+|[.](?![0-9])", ""))
    return F.filter(F.split(text, " "), lambda w: w != "")


def _kind(word: Column) -> Column:
    """A word without its placeholder's value."""
    return F.when(word.startswith("<"), F.substring_index(word, "=", 1)).otherwise(word)


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """rows with words, a row for each window: at (from 0) and the hash of its canonical words.

    Words are hashed once; then hashes of 2, 4, 8 ... words in a row are made of those of half as many.
    """
    hashed = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(_kind(w))))
    size = 1
    while size < window:
        hashed = hashed.withColumn("hashes", F.zip_with("hashes", F.slice("hashes", size + 1, F.size("words")), lambda a, b: F.xxhash64(a, b)))
        size *= 2
    whole = F.when(F.size("words") >= window, F.slice("hashes", 1, F.size("words") - window + 1))
    # The outer form: of the other, the planner makes a filter on the array's size, which works all of the above out anew.
    return hashed.select(*rows.columns, F.posexplode_outer(whole).alias("at", "hash")).filter(F.col("hash").isNotNull())


def _spans(words: Column, n: int, exact: bool) -> Column:
    """Hashes of every n words in a row, with their placeholders' values if exact: two spans of a power of two cover n."""
    hashes, size = F.transform(words, lambda w: F.xxhash64(w if exact else _kind(w))), 1
    pair = lambda h, step: F.zip_with(h, F.slice(h, step + 1, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    while 2 * size <= n:
        hashes, size = pair(hashes, size), 2 * size
    if n > size:
        hashes = pair(hashes, n - size)
    return F.when(F.size(words) >= n, F.slice(hashes, 1, F.greatest(F.size(words) - n + 1, F.lit(0))))


def _whole_items(told: DataFrame, ids: list[str], asked: DataFrame, window: int, literals: int, evidence: int) -> DataFrame | None:
    """Hits of items (item_id, words) without a window of enough literals: each is one window of its whole length.

    Of fewer than `literals` literals, its values must be the item's. It is found by as many of its words as a window has, those
    with the most literals, and then compared whole; so documents are hashed once for each length up to `window` at most.
    """
    plain = lambda words: F.size(F.filter(words, lambda w: ~w.startswith("<")))
    size = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(size - window + 1, F.lit(1)))
    counts = F.transform(starts, lambda i: F.struct(plain(F.slice("words", i, window)).alias("n"), (-i).alias("first")))
    short = (asked.filter(size > 0).withColumn("top", F.array_max(counts)).filter((size < window) | (F.col("top.n") < literals))
             .select("item_id", "words", (-F.col("top.first") - 1).alias("skip"), F.least(size, F.lit(window)).alias("n"), (plain("words") < literals).alias("exact")))
    out = None
    for n, exact in sorted(tuple(r) for r in short.select("n", "exact").distinct().collect()):
        own = short.filter((F.col("n") == n) & (F.col("exact") == exact)).select(
            "item_id", "skip", F.col("words").alias("item_words"), F.get(_spans(F.slice("words", F.col("skip") + 1, n), n, exact), F.lit(0)).alias("hash"))
        at = told.select(*ids, "words", F.posexplode_outer(_spans(F.col("words"), n, exact)).alias("at", "hash")).filter(F.col("hash").isNotNull())
        letters = F.length(F.array_join(F.transform("item_words", lambda w: F.regexp_replace(w, "^<[a-z]+>=", "")), ""))
        met = at.join(own, "hash").filter((F.col("at") >= F.col("skip")) & ((letters >= evidence) | (F.size("words") == F.size("item_words")))).select(
            *ids, "item_id", (F.col("at") - F.col("skip")).alias("distance"), F.lit(0).alias("item_at"), F.lit(1).alias("item_windows"), "item_words",
            F.slice("words", F.col("at") - F.col("skip") + 1, F.size("item_words")).alias("doc_words"))
        met = met.filter(F.col("doc_words") == F.col("item_words") if exact else F.transform("doc_words", _kind) == F.transform("item_words", _kind))
        out = met if out is None else out.unionByName(met)
    return out


def _row(text: Column) -> Column:
    """A key of the text, by which rows are judged one by one: rows of equal texts hold the same items."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _matches(own: DataFrame, benchmark: DataFrame, keys: list[str], window: int, literals: int, broadcast_windows: int, each_window: bool, evidence: int) -> DataFrame:
    """Best consistent match of each `keys` and item_id, for rows of `own` (keys, row, text); see leaks()."""
    items = benchmark.select(benchmark["item_id"].alias("item_id"), benchmark["text"].cast("string").alias("text")).filter(F.col("item_id").isNotNull())
    items = items.select("item_id", marked_words(F.col("text")).alias("words"))
    asked = _windows(items, window).select(
        "item_id", F.col("at").alias("item_at"), "hash", F.slice("words", F.col("at") + 1, window).alias("item_words"),
        (F.size("words") - window + 1).alias("item_windows"))
    asked = asked.filter(F.size(F.filter("item_words", lambda w: ~w.startswith("<"))) >= literals)
    hashes = asked.groupBy("hash").count()
    if hashes.limit(broadcast_windows + 1).count() <= broadcast_windows:
        hashes = F.broadcast(hashes)
    ids = list(dict.fromkeys([*keys, "row"]))
    marked = own.select(*ids, marked_words(F.col("text")).alias("words"))
    told = _windows(marked, window)
    told = told.join(hashes, "hash").select("hash", *ids, F.col("at").alias("doc_at"), F.slice("words", F.col("at") + 1, window).alias("doc_words"))
    hits = told.join(asked, "hash").filter(F.transform("doc_words", _kind) == F.transform("item_words", _kind))
    hits = hits.select(*ids, "item_id", (F.col("doc_at") - F.col("item_at")).alias("distance"), "item_at", "item_windows", "item_words", "doc_words")
    whole = _whole_items(marked, ids, items, window, literals, evidence)
    hits = hits if whole is None else hits.unionByName(whole)
    slots = F.filter(F.arrays_zip("item_words", "doc_words"), lambda p: p["item_words"].startswith("<"))
    # A match has a row for each window of the item at most, so what is gathered is bounded by the item's length.
    kept = F.when(F.col("item_words") == F.col("doc_words"), F.col("item_at"))
    matches = hits.select(*ids, "item_id", "distance", "item_at", "item_windows", kept.alias("kept_at"), slots.alias("slots")).groupBy(
        *ids, "item_id", "distance").agg(F.size(F.collect_set("item_at")).alias("n_windows"), F.size(F.collect_set("kept_at")).alias("n_kept"),
                                         F.max("item_windows").alias("item_windows"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    differ = F.filter("slots", lambda p: p["item_words"] != p["doc_words"])
    same = F.filter("slots", lambda p: p["item_words"] == p["doc_words"])
    changed, stayed = (F.transform(x, lambda p: p["item_words"]) for x in (differ, same))
    # Windows with the item's own values are no chance fit, whatever the others hold.
    agrees = ~F.arrays_overlap(changed, stayed)
    counted, n_differ = F.when(agrees, F.col("n_windows")).otherwise(F.col("n_kept")), F.when(agrees, F.size(differ)).otherwise(0)
    judged = matches.filter(agrees | (F.lit(each_window) & (F.col("n_kept") > 0))).select(*keys, "item_id", F.struct(
        counted.cast("long").alias("n_windows"), (-n_differ).alias("same"), (counted / F.col("item_windows")).alias("coverage")).alias("match"))
    return judged.groupBy(*keys, "item_id").agg(F.max("match").alias("match"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, broadcast_windows: int = BROADCAST_WINDOWS,
          each_window: bool = False, evidence: int = 0) -> DataFrame:
    """Pairs (doc_id, item_id) of documents (doc_id, text) that hold a benchmark item (item_id, text), as posed or with other values.

    n_windows: windows that agree, coverage: their share of the item's, n_slots: differing values, exact: whether all values are the
    item's. A pair's best consistent match counts; with `each_window` also one in which a value both stays and changes, by its windows that have the
    item's own values. Items found whole that have fewer than `evidence` letters and digits count only where they are all of a text. An item without a window of `literals` literals, as one of fewer than `window`
    words, is one window of its whole length, with its own values where it has fewer literals; null and empty texts have none. Rows with a null id on either side are left out of the pairs; rows that
    repeat an id are matched each, and the best of them counts. Empty tables give no pairs; further columns are not read.
    """
    own = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    best = _matches(own.withColumn("row", _row(F.col("text"))), benchmark, ["doc_id"], window, literals, broadcast_windows, each_window, evidence)
    return best.select("doc_id", "item_id", F.col("match.n_windows").alias("n_windows"), F.col("match.coverage").alias("coverage"),
                       (-F.col("match.same")).cast("long").alias("n_slots"), (F.col("match.same") == 0).alias("exact"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_found: int = BROADCAST_FOUND) -> DataFrame:
    """The rows of `docs`, all columns, whose own text holds no item of the benchmark, by each window and with EVIDENCE; null and repeated ids are judged row by row."""
    row = "row"
    while row in docs.columns:
        row += "_"
    own = docs.select(docs["text"].cast("string").alias("text")).withColumn("row", _row(F.col("text")))
    found = _matches(own, benchmark, ["row"], WINDOW, LITERALS, BROADCAST_WINDOWS, True, EVIDENCE).select(F.col("row").alias(row)).distinct()
    found = checkpointed(found)
    if found.limit(broadcast_found + 1).count() <= broadcast_found:
        found = F.broadcast(found)  # so the texts stay where they are
    return docs.withColumn(row, _row(docs["text"].cast("string"))).join(found, row, "left_anti").drop(row)
