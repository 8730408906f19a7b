"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs n + n * n / quadratic, linear work plus attention. Within a block of documents, pieces go in
descending order to the sequence of lowest cost that has token capacity left; what doesn't fit is cut off and
goes on as a piece of its own. A block gets as few sequences as hold its tokens, so it is padded by less than one.
"""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from geoloom.llm.bpe import encoded

CAPACITY = 1024
BLOCK_TOKENS = 1 << 22  # tokens packed together: 16 MB of ids in a task
END = b"\0\0\0\0"
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "cost double")


def piece_cost(n: int, quadratic: float) -> float:
    return n + n * n / quadratic


def assign(lengths: list[int], capacity: int = CAPACITY, quadratic: float = 1024.0) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences are numbered from 0."""
    pieces = []
    for doc, n in enumerate(lengths):
        pieces += [(-min(capacity, n - at), doc, at) for at in range(0, n, capacity)]
    heapq.heapify(pieces)
    room = [capacity] * -(-sum(lengths) // capacity)
    open_ = [(0.0, s) for s in range(len(room))]
    out = []
    while pieces:
        size, doc, at = heapq.heappop(pieces)
        cost, s = heapq.heappop(open_)
        put = min(-size, room[s])
        out.append((doc, at, put, s, capacity - room[s]))
        room[s] -= put
        if room[s]:
            heapq.heappush(open_, (cost + piece_cost(put, quadratic), s))
        if put < -size:
            heapq.heappush(pieces, (size + put, doc, at + put))
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, quadratic: float = 1024.0,
         block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of at most `capacity` tokens.

    A null text counts as empty; every document ends in id 0, so an empty one is a single token. Null and repeated ids
    are packed like any other row; columns besides doc_id and text are not read. Tasks pack their own rows, so
    nothing is shuffled and no key can be hot; sequence_id holds the task, its block and the sequence there.
    """
    def run(batches):
        task, block, held, names, total = TaskContext.get().partitionId(), 0, [], [], 0
        for ids, data in encoded(batches, tokenizer_path):
            for doc_id, own in zip(ids, data):
                held.append(own + END)
                names.append(doc_id)
                total += len(own) // 4 + 1
                if total >= block_tokens:
                    yield packed(names, held, (task << 36) + (block << 22))
                    block, held, names, total = block + 1, [], [], 0
        if held:
            yield packed(names, held, (task << 36) + (block << 22))

    def packed(names, held, first):
        rows = [(names[doc], at, n, zlib.crc32(memoryview(held[doc])[4 * at:4 * (at + n)]), len(held[doc]) // 4, first + s, offset, piece_cost(n, quadratic))
                for doc, at, n, s, offset in assign([len(h) // 4 for h in held], capacity, quadratic)]
        kinds = [pa.int64()] * 7 + [pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
