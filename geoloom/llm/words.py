"""Words of whole texts as arrays: boundaries, hashes and windows, a block of texts at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_BYTES = 1 << 19  # texts are worked on in blocks of about this size, which bounds memory
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finisher that spreads 64 bits evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def letter_codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + (1 << 18))
        for name, base in (("up", _STEP), ("down", _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span data[start:end]; equal bytes give equal hashes wherever they stand."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letter_codes(lower)[data] * down[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64))


def spans(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], member.view(np.int8), [0]))))
    return edge[0::2], edge[1::2]


def text_blocks(texts):
    """(first index, texts as bytes) in blocks of about BLOCK_BYTES; a longer text is a block of its own."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        data = (text or "").encode()
        if held and size + len(data) > BLOCK_BYTES:
            yield first, held
            held, size, first = [], 0, i
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held


class Block:
    """The words of a block of texts. `bounds[i]:bounds[i + 1]` are the words of text i."""

    def __init__(self, held: list[bytes]):
        self.data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
        sizes = np.fromiter((len(h) + 1 for h in held), np.int64, len(held))
        self.edges = np.concatenate(([0], np.cumsum(sizes)))
        self.starts, self.ends = spans(~_SPACE[self.data])
        self.bounds = np.searchsorted(self.starts, self.edges)
        self.counts = np.diff(self.bounds)

    def hashes(self, lower: bool = True) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, lower)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n words in a row, in the order of their first word."""
    m = max(0, len(hashes) - n + 1)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total = total * _STEP + hashes[k:k + m]
    return mix(total)


def repeated(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the pair (owner, key) of each item occurs more than once."""
    tagged = mix(keys + owner.astype(np.uint64) * _STEP)
    order = np.argsort(tagged, kind="stable")
    same = np.concatenate(([False], tagged[order][1:] == tagged[order][:-1], [False]))
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def seen_before(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether an earlier item has the same owner and key."""
    tagged = mix(keys + owner.astype(np.uint64) * _STEP)
    order = np.argsort(tagged, kind="stable")
    out = np.zeros(len(keys), bool)
    if len(keys):
        out[order[1:]] = tagged[order][1:] == tagged[order][:-1]
    return out


def kept_rows(docs: DataFrame, judge) -> DataFrame:
    """The rows of `docs`, all columns, for which judge(texts of a block as bytes) gives true."""
    names = docs.columns
    place = names.index("text")

    def run(batches):
        for batch in batches:
            keep = [judge(held) for _, held in text_blocks(batch.column(place).to_pylist())]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
