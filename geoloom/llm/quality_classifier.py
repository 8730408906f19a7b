"""A quality classifier by attention-based multiple-instance learning.

A text is a bag of passages: its words are dealt evenly into passages of about PASSAGE_WORDS, so a long text has many, each judged as
those of a short one are, and every word counts. A passage is encoded as h = tanh(W x + c) of its features x. Gated
attention weighs it by softmax(a . (tanh(V h) * sigmoid(U h))) within its text, and the weighted sum of h is scored by a
logistic unit. All weights are learned together from document labels only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.quality_rules import sums
from geoloom.llm.words import Block, kept_rows, repeated, seen_before, text_blocks, windows

PASSAGE_WORDS = 48
MOST_PASSAGES = 64  # default of passages() alone; training and scoring set no such limit
TRAINING_PASSAGES = 256  # passages, evenly apart, at most of a document that the weights are learned from; scores use all
TRAINING_DOCUMENTS = 4000  # labelled documents at most that the weights are learned from, drawn by their id's hash
CUT = 0.7
_CLASSES = {  # fixed values: kinds of bytes that are counted
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#*$%&|<>",
    "stop": b".,;:?", "shout": b"!", "quote": b"\"'()[]{}", "link": b"/\\@_=+~^`-", "line": b"\n",
}
FEATURES = len(_CLASSES) + 9


def passages(block: Block, most: int | None = MOST_PASSAGES) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, text of each passage); a text without words is one passage of zeros. `most` passages a text, None: no limit."""
    counts = block.counts
    n_pass = np.clip(-(-counts // PASSAGE_WORDS), 1, most)
    own = np.repeat(np.arange(len(counts)), n_pass)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(n_pass) - n_pass, n_pass)
    first = block.bounds[own] + counts[own] * nth // n_pass[own]
    last = block.bounds[own] + counts[own] * (nth + 1) // n_pass[own]
    words = np.maximum(last - first, 1)
    edges = np.append(block.starts, len(block.data))
    begin, end = np.minimum(edges[first], len(block.data)), np.where(last > first, block.ends[np.maximum(last, 1) - 1] if len(block.ends) else 0, edges[first])
    between = lambda total: total[end] - total[begin]
    run = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    size = np.maximum(end - begin, 1)
    columns = [between(run(np.isin(block.data, np.frombuffer(kind, np.uint8)))) / size for kind in _CLASSES.values()]
    columns.append(between(run(block.data >= 128)) / size)

    of_words = lambda flags: (run(flags)[last] - run(flags)[first]) / words
    hashes, owner, length = block.hashes(), block.owner(), (block.ends - block.starts).astype(float)
    passage = np.repeat(np.arange(len(own)), last - first)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    four = windows(hashes, 4)
    inside = owner[:len(four)] == owner[3:] if len(four) else np.zeros(0, bool)
    twice = np.zeros(len(hashes), bool)
    twice[:len(four)][inside] = repeated(owner[:len(four)][inside], four[inside])
    end_byte = block.data[np.maximum(block.ends, 1) - 1] if len(hashes) else block.data[:0]
    mean = of_words(length)
    columns += [of_words(same), of_words(seen_before(passage, hashes)), of_words(twice), mean / 10,
                np.sqrt(np.maximum(of_words(length * length) - mean * mean, 0)) / 10,
                of_words(np.isin(end_byte, np.frombuffer(_CLASSES["symbol"] + _CLASSES["shout"], np.uint8))),
                of_words(length > 1), np.log1p(counts[own]) / 8]
    x = np.stack(columns, 1)
    x[(last == first)] = 0
    return np.sqrt(np.abs(x)).astype(np.float32), own


class Attention:
    """Weights, their training and scoring."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 7):
        draw = np.random.default_rng(seed)
        normal = lambda *s: draw.normal(0, 1 / np.sqrt(s[0]), s)
        self.w = {"W": normal(FEATURES, hidden), "c": np.zeros(hidden), "V": normal(hidden, gate), "U": normal(hidden, gate), "a": normal(gate, 1)[:, 0],
                  "out": normal(hidden, 1)[:, 0], "bias": np.zeros(1)}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def _forward(self, x, own, n):
        w = self.w
        h = np.tanh(x @ w["W"] + w["c"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = np.exp(np.clip((t * s) @ w["a"], -30, 30))
        total = np.bincount(own, e, n)
        share = e / total[own]
        edges = np.searchsorted(own, np.arange(n + 1))
        z = np.stack([sums(share * h[:, k], edges) for k in range(h.shape[1])], 1)
        return h, t, s, share, z, 1 / (1 + np.exp(-(z @ w["out"] + w["bias"][0])))

    def scores(self, x, own, n) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale, own, n)[-1]

    def fit(self, x, own, labels, rounds: int = 200, rate: float = 0.02, decay: float = 1e-4) -> None:
        """Adam on the logistic loss; `own` ascends and numbers the bags from 0."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x, n, w = (x - self.mean) / self.scale, len(labels), self.w
        first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        for step in range(1, rounds + 1):
            h, t, s, share, z, p = self._forward(x, own, n)
            d = (p - labels) / n
            dz = d[:, None] * w["out"]
            up = dz[own]
            dshare = (h * up).sum(1)
            de = share * (dshare - np.bincount(own, share * dshare, n)[own])
            dt, ds = de[:, None] * w["a"] * s * (1 - t * t), de[:, None] * w["a"] * t * s * (1 - s)
            dh = (share[:, None] * up + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
            slope = {"W": x.T @ dh, "c": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "a": (t * s).T @ de, "out": z.T @ d, "bias": np.array([d.sum()])}
            for k, g in slope.items():
                g = g + decay * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)


def held_out(doc_id="doc_id"):
    """Documents whose labels aren't learned from: crc32 of the id as text leaves 2 by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS) -> Attention:
    """Learn from at most `most` labelled documents that are not held out; the features of at most TRAINING_PASSAGES of each come to the driver, 80 MB in all.

    Labels that differ for one doc_id are averaged; null labels don't count. Without labels of both kinds scores are even.
    """
    def evenly(x):
        return x if len(x) <= TRAINING_PASSAGES else x[np.arange(TRAINING_PASSAGES) * len(x) // TRAINING_PASSAGES]

    def run(batches):
        for batch in batches:
            label = batch.column("label").to_pylist()
            for first, held in text_blocks(batch.column("text").to_pylist()):
                x, own = passages(Block(held), None)
                edges = np.searchsorted(own, np.arange(len(held) + 1))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(held)), pa.array(label[first:first + len(held)], pa.float64()),
                                                  pa.array([evenly(x[a:b]).tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], names=["doc_id", "label", "bag"])

    known = (labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("double").alias("quality")).filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.avg("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # `known` has at most `most` rows. A doc_id that many rows repeat counts once.
    bags = own.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label double, bag binary")
    rows = bags.groupBy("doc_id").agg(F.min(F.struct("label", "bag")).alias("x")).select("doc_id", "x.*").orderBy("doc_id").collect()
    model = Attention()
    target = np.array([r["label"] for r in rows])
    if not len(rows) or target.min() == target.max():
        model.w = {k: np.zeros_like(v) for k, v in model.w.items()}
        if len(rows):
            model.w["bias"][0] = 4.0 * (2 * target[0] - 1)
        return model
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    model.fit(np.concatenate(bags).astype(float), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), target)
    return model


def score(docs: DataFrame, model: Attention, cut: float = CUT) -> DataFrame:
    """Score every document (doc_id, text): doc_id, held_out, score, predicted. Null text counts as empty.

    Empty texts have a score like any other; null and repeated ids are scored row by row; only the text is an input, other
    columns are not read.
    """
    def run(batches):
        for batch in batches:
            parts = []
            for _, held in text_blocks(batch.column("text").to_pylist()):
                x, own = passages(Block(held), None)
                parts.append(model.scores(x.astype(float), own, len(held)))
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts), pa.float64())], names=["doc_id", "score"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Attention, cut: float = CUT) -> DataFrame:
    """The rows of `docs`, all columns, with a score of at least `cut`."""
    def judge(held):
        x, own = passages(Block(held), None)
        return model.scores(x.astype(float), own, len(held)) >= cut

    return kept_rows(docs, judge)
