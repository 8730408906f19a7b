"""Groups of documents whose word n-gram sets overlap: exact Jaccard links and their connected components.

The document by n-gram incidence matrix A is sparse, and the overlap of two documents is an entry of A times its
transpose. The product is worked out in blocks:
* Documents with the same set are one row of A; only classes of equal sets are multiplied.
* A set of n has a prefix of n - ceil(t n) + 1 n-grams in an order common to all documents, and two sets with Jaccard t
  share an n-gram of both prefixes. So only columns of prefixes pick entries of the product. The order puts n-grams
  that a sample of documents shows to be frequent last; any order gives the same links, this one gives few entries.
* First each row is multiplied with one other at most: the first row of most of its columns. Rows that this leaves outside the
  largest component of a column are multiplied with TRIES rows of that component at most, those of some drawn by hash that have the
  nearest sketches: what has linked to a first row lies nearer the middle of a group than it. This is done again while it joins
  many rows, as a poor first row leaves a group in several large components, whose rows would all meet. Then come the entries between rows that the links so far have
  not joined, and of those none between two rows of a column's largest component. So a group of n near copies
  costs about n entries instead of n * n, and every link that could join two components is tried.
* Each row has a sketch: the parities of its n-grams in SKETCH parts. Two rows differ in at least as many n-grams as their
  sketches in bits, so these steps only let pairs meet whose sketches leave room for the bound.
* In these blocks overlap counts are accumulated over the prefix columns, and an entry is dropped if its count so far and the
  n-grams that stand behind in the order can't reach the bound that the two sizes give. For the others the rest of
  the two rows is multiplied too.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.components import components
from geoloom.llm.words import Block, mix, text_blocks, windows
from geoloom.session import shared_dir

WIDTH = 6  # bytes of an n-gram's number in stored sets
SAMPLE = 16  # one text of so many tells frequent n-grams
FREQUENT = 4  # sampled texts that make an n-gram frequent
MOST_FREQUENT = 1 << 18  # n-grams at most that tasks are told of: 2 MB. Further ones merely keep their place in the order
TRIES = 6  # rows of a column's largest component that each row outside it is multiplied with, before the exact step
SKETCH = 512  # bits of a sketch
TURNS = 6  # times at most that rows outside are multiplied so
JOINING = 20  # links of a turn that make another one worth while, if they are so many hundredths of its pairs too
CHANCE = 3  # sketches may differ in so many bits more, times 0 to TRIES - 1, and yet be taken for nearer
BROADCAST_NUMBERS = 2_000_000  # numbers up to this many are sent to all tasks, 50 MB there; more are joined by a shuffle


def sent(numbers: DataFrame) -> DataFrame:
    """A column of numbers for a join: sent to all tasks if it is short enough."""
    return F.broadcast(numbers) if numbers.limit(BROADCAST_NUMBERS + 1).count() <= BROADCAST_NUMBERS else numbers


def ngram_sets(texts: list[str | None], n: int, lower: bool = True) -> list[np.ndarray]:
    """The sorted numbers (48 bits) of each text's distinct word n-grams; a shorter text is one n-gram."""
    out = []
    for _, held in text_blocks(texts):
        block = Block(held)
        hashes = block.hashes(lower)
        grams = windows(hashes, n)
        for i, count in enumerate(block.counts):
            first = block.bounds[i]
            if count >= n:
                own = grams[first:first + count - n + 1]
            elif count:
                own = windows(hashes[first:first + count], count) ^ np.uint64(count)
            else:
                own = grams[:0]
            out.append(np.unique(own >> np.uint64(16)))
    return out


def packed(numbers: np.ndarray) -> bytes:
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return wide.view("<u8").ravel().astype(np.uint64)


def set_key(numbers: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    if not len(numbers):
        return 0, 0
    a, b = mix(numbers + np.uint64(1)), mix(numbers ^ np.uint64(0x5851F42D4C957F2D))
    return int(mix(np.array([a.sum()]))[0].view(np.int64)), int(mix(np.array([b.sum() ^ np.uint64(len(a))]))[0].view(np.int64))


def sketch(numbers: np.ndarray) -> np.ndarray:
    """The parity of how many numbers fall in each of SKETCH parts, as 64-bit words."""
    odd = np.bincount((numbers & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _frequent(own: DataFrame, n: int) -> np.ndarray:
    """N-grams that are frequent in a sample drawn by the text's hash, most frequent last, at most MOST_FREQUENT."""
    def run(batches):
        for batch in batches:
            for numbers in ngram_sets(batch.column("text").to_pylist(), n):
                yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int64))], names=["gram"])

    sample = own.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    counted = sample.mapInArrow(run, "gram long").groupBy("gram").count().filter(F.col("count") >= FREQUENT)
    rows = counted.orderBy(F.desc("count"), "gram").limit(MOST_FREQUENT).collect()
    return np.array([r["gram"] for r in reversed(rows)], np.uint64)


def _prefixes(own: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Per document: place, doc_id, set key, size, prefix and sketch."""
    by_gram = np.argsort(frequent)
    grams = frequent[by_gram]

    def run(batches):
        for batch in batches:
            sets = ngram_sets(batch.column("text").to_pylist(), n)
            keys = [set_key(s) for s in sets]
            prefixes = []
            for s in sets:
                size = len(s) - (-(-percent * len(s) // 100)) + 1 if len(s) else 0
                at = np.minimum(np.searchsorted(grams, s), max(0, len(grams) - 1))
                late = np.where(grams[at] == s, by_gram[at] + 1, 0) if len(grams) else np.zeros(len(s), np.int64)
                prefixes.append(s[np.argsort(late, kind="stable")[:size]].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), batch.column("doc_id"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
                 pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))],
                names=["place", "doc_id", "k1", "k2", "n_shingles", "prefix", "sketch"])

    return own.select("place", "doc_id", "text").mapInArrow(run, "place long, doc_id long, k1 long, k2 long, n_shingles long, prefix array<long>, sketch array<long>")


def _links(pairs: DataFrame, own: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of places whose overlap reaches the threshold: whole rows of the incidence matrix multiplied."""
    def whole(batches):
        for batch in batches:
            sets = ngram_sets(batch.column("text").to_pylist(), n)
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array([packed(s) for s in sets], pa.binary())], names=["place", "grams"])

    def run(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                x, y = unpacked(left.as_py()), unpacked(right.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    used = pairs.select(F.explode(F.array("a", "b")).alias("place")).distinct()
    rows = own.select("place", "text").join(sent(used), "place", "left_semi").mapInArrow(whole, "place long, grams binary")
    wide = (pairs.join(rows.select(F.col("place").alias("a"), F.col("grams").alias("left")), "a")
            .join(rows.select(F.col("place").alias("b"), F.col("grams").alias("right")), "b"))
    return wide.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _numbered(docs: DataFrame, place: str, folder: str | None) -> tuple[DataFrame, str]:
    """(docs with a column of unique row numbers, written once; the folder it is in).

    The numbers follow the splits of a scan, which each job plans anew by the cores there are, so they are read from files.
    """
    root = folder or re.sub(r"/?$", f"/jaccard-{uuid.uuid4().hex}", shared_dir(docs.sparkSession))
    docs.withColumn(place, F.monotonically_increasing_id()).write.parquet(f"{root}/docs")
    return docs.sparkSession.read.parquet(f"{root}/docs"), root


def _open(columns: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows (gram, node, size, at, …) of columns that hold several components: with their `component` and the column's largest, `top`."""
    now = columns.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    shares = now.groupBy("gram", "component").agg(F.count("*").alias("share"))
    largest = shares.groupBy("gram").agg(F.count("*").alias("parts"), F.max(F.struct("share", "component")).alias("top")).filter("parts > 1")
    return now.join(largest.select("gram", F.col("top.component").alias("top")), "gram")


def _differ(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return sum(F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(SKETCH // 64))


def _nearer(open_: DataFrame, alone: Column, enough, percent: int, turn: int) -> DataFrame:
    """The pairs (a, b), a < b, of rows outside a column's largest component and TRIES rows of that component at most for each: of those
    drawn from the column by hash, anew each turn, the ones whose sketches are nearest, but for some chance."""
    drawn = F.struct(F.col("node").alias("leader"), F.col("size").alias("b_size"), F.col("at").alias("b_at"), F.col("sketch").alias("b_sketch"))
    leads = open_.filter("component = top").groupBy("gram").agg(*[F.min_by(drawn, F.xxhash64("node", F.lit(k), F.lit(turn))).alias(str(k)) for k in range(TRIES)])
    leads = leads.select("gram", F.explode(F.array_distinct(F.array(*[str(k) for k in range(TRIES)]))).alias("lead")).select("gram", "lead.*")
    differ = _differ("sketch", "b_sketch")
    near = open_.filter("component <> top").join(leads, "gram").filter(
        enough(alone, F.col("size"), F.col("b_size")) & (F.lit(100 + percent) * differ <= F.lit(100 - percent) * (F.col("size") + F.col("b_size"))))
    chance = lambda k: F.pmod(F.xxhash64("leader", F.lit(k)), F.lit(CHANCE * k + 1))
    best = near.groupBy("node").agg(*[F.min_by("leader", differ + chance(k)).alias(str(k)) for k in range(TRIES)])
    best = best.select(F.explode(F.array_distinct(F.array(*[str(k) for k in range(TRIES)]))).alias("leader"), "node")
    return best.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()


def _grouped(own: DataFrame, n: int, percent: int, root: str) -> DataFrame:
    """(place, doc_id, n_shingles, component, component_id) of rows (place, doc_id, text); places are unique and read the same each time."""
    spark = own.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    sets = kept(_prefixes(own, n, percent, _frequent(own, n)), "sets")
    classes = kept(sets.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("place").alias("node"), F.min("doc_id").alias("first_doc")), "classes")
    copies = sets.select("place", "k1", "k2").join(classes, ["k1", "k2"]).filter("place <> node").select("place")
    rows = (sets.select("place", "n_shingles", "prefix").join(sent(copies), "place", "left_anti")
            .select(F.col("place").alias("node"), F.col("n_shingles").alias("size"), F.posexplode("prefix").alias("at", "gram")))
    # Only columns of two rows or more matter.
    shared = kept(rows.groupBy("gram").agg(F.count("*").alias("rows"), F.min("node").alias("leader")).filter("rows > 1"), "shared").select("gram", "leader")
    near = rows.join(sent(shared.select("gram")), "gram", "left_semi")
    columns = kept(near.join(shared, "gram").select("gram", "node", "size", "at", "leader"), "columns")

    enough = lambda overlap, x, y: F.lit(100 + percent) * overlap >= F.lit(percent) * (x + y)
    reach = lambda both, a, b: enough(both + F.least(*[F.col(f"{x}_size") - F.col(f"{x}_at") - 1 for x in (a, b)]), F.col(f"{a}_size"), F.col(f"{b}_size"))
    lead = columns.filter("node = leader").select("gram", F.col("size").alias("b_size"), F.col("at").alias("b_at"))
    # A row may share more columns with a leader than that leads, so only what each column alone rules out is dropped here.
    alone = F.least("at", "b_at") + F.least(F.col("size") - F.col("at"), F.col("b_size") - F.col("b_at"))
    firsts = columns.filter("node <> leader").join(lead, "gram").filter(enough(alone, F.col("size"), F.col("b_size"))).groupBy("node", "leader").agg(F.count("*").alias("hits"))
    best = firsts.groupBy("node").agg(F.max(F.struct("hits", (-F.col("leader")).alias("first"))).alias("best"))
    tried = kept(best.select((-F.col("best.first")).alias("a"), F.col("node").alias("b")), "tried")
    joined = components(kept(_links(tried, own, n, percent), "links/round=1"))

    sketches = sets.select(F.col("place").alias("node"), "sketch")
    open_ = _open(columns.select("gram", "node", "size", "at"), joined).join(sketches, "node")
    for turn in range(1, TURNS + 1):
        open_ = kept(open_, f"open/round={turn}")
        more = kept(_nearer(open_, alone, enough, percent, turn).join(tried, ["a", "b"], "left_anti"), f"more/round={turn}")
        found = kept(_links(more, own, n, percent), f"links/round={turn + 1}").count()
        tried = tried.unionByName(more)
        joined = components(spark.read.parquet(f"{root}/links").select("a", "b"))
        open_ = _open(open_.drop("component", "top"), joined)
        if found < max(JOINING, more.count() * JOINING // 100):  # the exact step has little left to join
            break

    open_ = kept(open_, f"open/round={turn + 1}")
    left = open_.filter("component <> top").select("gram", *[F.col(c).alias(f"a_{c}") for c in ("node", "size", "at", "component", "sketch")])
    differ = _differ("a_sketch", "sketch")
    # A pair meets once in each column that both have. It is dropped where what stands before and after can't suffice.
    meet = ((F.col("a_component") != F.col("component")) & ((F.col("component") == F.col("top")) | (F.col("a_node") < F.col("node")))
            & enough(F.least("a_at", "at") + F.least(F.col("a_size") - F.col("a_at"), F.col("size") - F.col("at")), F.col("a_size"), F.col("size"))
            & (F.lit(100 + percent) * differ <= F.lit(100 - percent) * (F.col("a_size") + F.col("size"))))
    swap = F.col("a_node") > F.col("node")
    either = lambda one, other: F.when(swap, F.col(other)).otherwise(F.col(one))
    hits = left.join(open_, "gram").filter(meet).select(
        either("a_node", "node").alias("a"), either("node", "a_node").alias("b"), either("a_size", "size").alias("a_size"), either("size", "a_size").alias("b_size"),
        either("a_at", "at").alias("a_at"), either("at", "a_at").alias("b_at"))
    counted = hits.groupBy("a", "b", "a_size", "b_size").agg(F.count("*").alias("both"), F.max("a_at").alias("a_at"), F.max("b_at").alias("b_at"))
    rest = counted.filter(reach(F.col("both"), "a", "b"))
    pairs = kept(rest.select("a", "b").join(tried, ["a", "b"], "left_anti"), "pairs")
    kept(_links(pairs, own, n, percent), f"links/round={turn + 2}")

    joined = components(spark.read.parquet(f"{root}/links").select("a", "b"))
    grouped = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = grouped.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = grouped.join(smallest, "component").select("k1", "k2", "component", "component_id")
    sized = sets.select("place", "doc_id", "k1", "k2", "n_shingles")
    names = ["place", "doc_id", "n_shingles", "component", "component_id"]
    return sized.filter("n_shingles > 0").join(named, ["k1", "k2"]).select(names).unionByName(
        sized.filter("n_shingles = 0").withColumns({"component": F.col("place"), "component_id": F.col("doc_id")}).select(names))


def jaccard_groups(docs: DataFrame, n: int = 4, percent: int = 85, folder: str | None = None) -> DataFrame:
    """Per document (doc_id, text): n_shingles and component_id, the smallest doc_id that links reach.

    Words are runs of non-space, A-Z lower-cased. A text of fewer than n words is one n-gram; a null, empty or blank one
    has none and is linked with nothing. Rows with a null or repeated doc_id take part like any other; a component
    of null ids only has a null id. An empty table gives no rows; further columns are not read. Numbered texts, sets and
    links are written under `folder`, by default the cluster's checkpoint folder. `docs` is read once.
    """
    own, root = _numbered(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), "place", folder)
    return _grouped(own, n, percent, root).select("doc_id", "n_shingles", "component_id")


def one_of_each_group(docs: DataFrame, n: int = 4, percent: int = 85, folder: str | None = None) -> DataFrame:
    """The rows of `docs`, all columns, one of each group: that of the smallest doc_id, nulls last. Texts without words all stay."""
    place = "place"
    while place in docs.columns:
        place += "_"
    numbered, root = _numbered(docs, place, folder)
    own = numbered.select(F.col(place).alias("place"), numbered["doc_id"].cast("long").alias("doc_id"), numbered["text"].cast("string").alias("text"))
    first = _grouped(own, n, percent, root).groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place")).alias("first")).select(F.col("first.place").alias(place))
    return numbered.join(first, place, "left_semi").drop(place)
