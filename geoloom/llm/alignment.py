"""The tokens of two tokenizers over one text, aligned by the bytes they cover.

Ends of tokens in bytes go into two dictionaries from end to index; ends that both hold cut the two id lists into groups, and
inside a group every two tokens that overlap are linked. A text is taken apart where no token of either
vocabulary can reach across: before white space that follows something else, and between a letter and a mark. Most parts are words
met before, so each is aligned once and remembered, and a text's groups are those of its parts in a row. Parts not met before
are aligned many as one text.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.skew import salted_join
from geoloom.session import shared_dir

KEPT_PARTS = 150_000  # parts remembered in a Python worker, and as many of the time before; further ones are worked out anew
PARTS_AT_ONCE = 20_000  # parts of a text joined at a time, which bounds memory
BROADCAST_PAIRS = 2_000_000  # counts of id pairs up to this many are sent to all tasks, about 100 MB there; more are joined by a shuffle
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
_ODD = re.compile(r"[\x1c-\x1f\u180e]")  # regex engines differ on whether these are white space


def align(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Groups and links of two lists of token sizes in bytes over the same text.

    (Index behind the last token in a, the same in b, index behind the last link) of each group, then (index in a, in b) of
    each link, in order. A stretch between two neighbouring ends of either list lies in one token of each: it is their link.
    """
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    end_a, end_b = (dict(zip(e.tolist(), range(1, len(e) + 1))) for e in (a_ends, b_ends))
    common = sorted(end_a.keys() & end_b.keys())
    ends = np.union1d(a_ends, b_ends)
    return (np.array([end_a[e] for e in common], np.int64), np.array([end_b[e] for e in common], np.int64), np.searchsorted(ends, common, "right"),
            np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends))


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters.values())}


class Aligner:
    """Aligned texts of a byte-level vocabulary (A) and a sentence piece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, size = _byte_letters(), self.a.get_vocab_size(with_added_tokens=True)
        names = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = np.array([len(t) for t in self.a_bytes]), np.array([len(t) for t in self.b_bytes])
        # White space or a mark that a piece of B joins to what stands before it ties two parts together; a space that does forbids any cut.
        plain = [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)]
        tied = {c for p in plain for c in re.findall(r"[^\s▁]([\s▁])", p)}
        tie = rf"(?:[{''.join(map(re.escape, sorted(tied)))}]\s*\S*)*" if tied else ""
        held = {c for p in plain for c in re.findall(rf"[{_LETTERS}]([{re.escape(_MARKS)}])", p)}
        marks = "".join(re.escape(c) for c in _MARKS if c not in held)
        self.parts = None if "▁" in tied or " " in tied else re.compile(rf"\s*+(?:[^\s{marks}]++(?<=[{_LETTERS}])(?=[{marks}])|\S+{tie})|\s+")
        n_a, n_b = size, len(pieces)
        self.written = [f"{i}{c}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for c in marks for i in range(n)]  # an id before each mark that may follow it
        self.written_sizes = np.array([len(w) for w in self.written])
        self.table = n_a, n_b
        self.young: dict[str, tuple[str, bytes, bytes]] = {}
        self.old: dict[str, tuple[str, bytes, bytes]] = {}

    def _tokens(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of a text that begins with a space, None if the tokens of either don't make up the text."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.b.encode(text[1:], num_threads=1)
        data = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return a, b

    def _aligned(self, text: str, starts: np.ndarray) -> list[tuple[str, bytes, bytes]] | None:
        """(groups as text, links as id pairs, counts) of each part of a text; `starts` are their first bytes."""
        tokens = self._tokens(text)
        if tokens is None:
            return None
        a, b = (np.array(ids, np.int64) for ids in tokens)
        a_to, b_to, link_to, link_a, link_b = align(self.a_sizes[a], self.b_sizes[b])
        a_from, b_from, link_from = (np.append(0, x[:-1]) for x in (a_to, b_to, link_to))
        # Each token's place among the written ids, where a group's a stand before its b.
        (n_a, n_b), codes = self.table, np.empty(len(a) + len(b), np.int64)
        a_marks, b_marks = a.copy(), b + 2 * n_a
        a_marks[a_to - 1] += n_a
        b_marks[b_to - 1] += n_b
        codes[np.arange(len(a)) + np.repeat(b_from, a_to - a_from)] = a_marks
        codes[np.arange(len(b)) + np.repeat(a_to, b_to - b_from)] = b_marks
        written = "".join(map(self.written.__getitem__, codes.tolist()))
        ends = np.cumsum(self.written_sizes[codes])[a_to + b_to - 1]
        pairs = (a[link_a] << 32 | b[link_b]).tobytes()
        group_ends = np.cumsum(self.a_sizes[a])[a_to - 1]
        first = np.searchsorted(group_ends, starts, "right")  # a part begins behind the group that ends there
        last = np.append(first[1:], len(a_to)) - 1
        counts = np.stack((a_to[last] - a_from[first], b_to[last] - b_from[first], last - first + 1), 1).astype("<u4").tobytes()
        words = [written[f:e] for f, e in zip(np.append(0, ends)[first].tolist(), (ends[last] - 1).tolist())]
        links = [pairs[f:e] for f, e in zip((8 * link_from[first]).tolist(), (8 * link_to[last]).tolist())]
        return list(zip(words, links, [counts[k:k + 12] for k in range(0, len(counts), 12)]))

    def _learn(self, parts: list[str]) -> dict[str, tuple[str, bytes, bytes] | None]:
        """Parts aligned as one text, those that begin with a mark behind a letter; where that can't be taken apart, each half by itself."""
        segments, mine = [" x"], []
        for part in parts:
            if not part[0].isspace():
                segments.append(" x")
            mine.append(len(segments))
            segments.append(part)
        found = self._aligned("".join(segments), np.cumsum([0, *(len(s.encode()) for s in segments[:-1])]))
        if found:
            return dict(zip(parts, map(found.__getitem__, mine)))
        if len(parts) == 1:
            return {parts[0]: None}
        half = len(parts) // 2
        return self._learn(parts[:half]) | self._learn(parts[half:])

    def learn(self, texts: list[list[str]]) -> None:
        """Parts of these texts that are not known yet."""
        if len(self.young) > KEPT_PARTS:
            self.young, self.old = {}, self.young
        new = set().union(*texts).difference(self.young)
        known = new & self.old.keys()
        self.young.update((p, self.old[p]) for p in known)
        new -= known
        for single in [p for p in new if p[-1].isspace()]:  # white space at its end would join what follows
            self.young.update(self._learn([single]))
            new.discard(single)
        rest = sorted(new, key=len)  # long parts apart from short ones
        at = 0
        while at < len(rest):
            end, size = at, 0
            while end < len(rest) and (end == at or size + len(rest[end]) <= 100_000):
                size += len(rest[end])
                end += 1
            self.young.update(self._learn(rest[at:end]))
            at = end

    def whole(self, text: str) -> tuple[str, bytes, bytes] | None:
        """A text aligned without cutting it."""
        found = self._aligned(" " + text, np.array([0]))
        return found[0] if found else None

    def texts(self, texts: list[str]) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray] | None]:
        """(digest of the groups, counts of tokens and groups, different id pairs, how often each) of each text, None without tokens."""
        cut = {i: self.parts.findall(" " + t) for i, t in enumerate(texts) if t and self.parts and not _ODD.search(t)}
        self.learn(list(cut.values()))
        out = []
        for i, text in enumerate(texts):
            pieces, known = [], True
            if i in cut:
                every = [self.young[p] for p in cut[i]]
                known = None not in every
                pieces = [every[k:k + PARTS_AT_ONCE] for k in range(0, len(every), PARTS_AT_ONCE)] if known else []
            if text and not pieces:
                own = self.whole(text)
                pieces = [[own]] if own else []
            if not pieces:
                out.append(None)
                continue
            digest, counts, tally = hashlib.sha256(), np.zeros(3, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
            for k, piece in enumerate(pieces):
                written, links, sizes = zip(*piece)
                digest.update(((";" if k else "") + ";".join(written)).encode())
                counts += np.frombuffer(b"".join(sizes), "<u4").reshape(-1, 3).sum(axis=0, dtype=np.int64)
                pairs, times = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
                if len(tally[0]):
                    pairs, back = np.unique(np.concatenate((tally[0], pairs)), return_inverse=True)
                    times = np.bincount(back, np.concatenate((tally[1], times)), len(pairs)).astype(np.int64)
                tally = pairs, times
            out.append((digest.hexdigest(), counts, *tally))
        return out


@lru_cache(2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner a Python worker and pair of vocabulary files."""
    return Aligner(a_path, b_path)


def _texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    def run(batches):
        own = aligner(a_path, b_path)
        for batch in batches:
            texts, at = [t or "" for t in batch.column("text").to_pylist()], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= 2_000_000):
                    size += len(texts[end])
                    end += 1
                none = ("", np.zeros(3, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                found = [x or none for x in own.texts(texts[at:end])]
                counts = np.array([c for _, c, _, _ in found])
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(p) for _, _, p, _ in found]))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, end - at), *[pa.array(counts[:, k]) for k in range(3)], pa.array([int(t.sum()) for *_, t in found], pa.int64()),
                     pa.array([d for d, *_ in found], pa.string()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p for _, _, p, _ in found]))),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([t for *_, t in found])))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                at = end

    return docs.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def aligned_tokens(docs: DataFrame, a_path: str, b_path: str, folder: str | None = None) -> DataFrame:
    """Per row (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A encodes the text behind a space, B adds one itself; strings of special tokens are plain text. A null or empty text, and
    one that the tokens of A or B don't make up byte by byte (a literal U+2581, say), has no tokens: all counts 0, digest ''. An id
    pair's count is the number of links that hold it in all rows; a link is best if no other A id has a larger count with its B
    id. Rows with a null or repeated doc_id stand for themselves and all count; an empty table gives no rows; further columns
    are not read. Each text's id pairs are written under `folder`, by default the cluster's checkpoint folder, and stay
    there, as the result reads them; a text's own row holds its different pairs only.
    """
    spark = docs.sparkSession
    root = folder or re.sub(r"/?$", f"/alignment-{uuid.uuid4().hex}", shared_dir(spark))
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    _texts(own, a_path, b_path).withColumn("place", F.monotonically_increasing_id()).write.parquet(f"{root}/texts")
    texts = spark.read.parquet(f"{root}/texts")
    linked = texts.select("place", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("place", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    linked.groupBy("pair").agg(F.sum("times").alias("links")).write.parquet(f"{root}/pairs")
    pairs = spark.read.parquet(f"{root}/pairs").withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    best = pairs.groupBy("b").agg(F.max("links").alias("most"))  # a row for each id of B at most
    counted = pairs.join(best, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))
    if pairs.count() <= BROADCAST_PAIRS:
        met = linked.join(F.broadcast(counted), "pair")
    else:
        met = salted_join(linked, counted, ["pair"], spread="place")
    sums = met.groupBy("place").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return texts.drop("pairs", "times").join(sums, "place", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
