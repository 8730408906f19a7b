"""Token counts by byte-pair merging with a heap and a linked list; ids are never made.

The lowest-ranked adjacent pair is merged first, the leftmost among equals, until no pair has a rank. A word has
as many tokens as symbols at the start less the merges.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

KEPT_WORDS = 500_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class MergeCounter:
    """Counts of one vocabulary file in the tokenizers library's format with word-end suffixes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.known = model["vocab"]
        tokenizer = Tokenizer.from_file(path)
        self.normalize = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.marks = sorted({s[:2] for s in special})
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one pre-token, whose bytes stand as visible letters."""
        symbols = [*word[:-1], word[-1] + self.suffix]
        symbols = [s for s in symbols if s in self.known]
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue  # a neighbour has been merged meanwhile
            merged = symbols[i] = a + b
            symbols[j] = ""
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (rank := ranks.get((merged, symbols[k]))) is not None:
                    heapq.heappush(heap, (rank, i, merged, symbols[k]))
            if (p := before[i]) >= 0 and (rank := ranks.get((symbols[p], merged))) is not None:
                heapq.heappush(heap, (rank, p, symbols[p], merged))
        return n - merges

    def chunk(self, chunk: str) -> int:
        """Tokens of a text without white space around it."""
        total = 0
        parts, specials = [chunk], 0
        if self.special and any(m in chunk for m in self.marks):
            parts = self.special.split(chunk)
            specials = len(parts) - 1
        for part in parts:
            for word, _ in self.split(self.normalize(part)) if part else ():
                if (n := self.words.get(word)) is None:
                    n = self.words[word] = self.word(word)
                total += n
        return total + specials

    def count(self, text: str) -> int:
        """White space is dropped by the vocabulary's rules and no token spans it, so chunks between it are counted."""
        if len(self.chunks) > KEPT_WORDS:
            self.chunks.clear()
            self.words.clear()
        known, total = self.chunks, 0
        for chunk in text.replace("\n", " ").split(" "):
            n = known.get(chunk)
            if n is None:
                n = known[chunk] = self.chunk(chunk)
            total += n
        return total


@lru_cache(2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """Per document (doc_id, text): UTF-8 bytes, tokens, and whether they are over `limit`.

    A null or empty text has no bytes and no tokens. Repeated rows are counted each; other columns are not read.
    """
    def run(batches):
        counts = counter(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = [counts.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
