"""Aligned tokens against both libraries on whole texts and a comparison of all byte ranges."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from geoloom.llm import alignment
from geoloom.llm.alignment import Aligner, align, aligned_tokens
from geoloom.llm.queries import BYTE_BPE, PIECES

from test_llm_tokens import some_texts

A, B = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
A.encode_special_tokens = True
MORE = ["x▁y z", "▁", " lead", "  two", "tail ", "a\r\nb\r c\r", "crlf;\r\n  next();\r\n", "\r", "one\x1ftwo !\x1c x", "<s> </s> <unk> <0x41>", "日本 語。", "é ́x", " nbsp  x y",
        "end.\n\n\n    indented\n", "\t\ttabs\n", "🙂🙂🙂 ok 👩‍👩‍👧", "a" * 3000, "\x00 null", "﻿bom ​ zero", "ﬁ ﬂ Ⅷ ½"]
SCHEMA = "doc_id long, text string, pair string, place string, times long, b long"
LETTERS = {v: k for k, v in alignment._byte_letters().items()}


def ranges(sizes):
    at = [0]
    for s in sizes:
        at.append(at[-1] + s)
    return list(zip(at, at[1:]))


def byte_tokens(text):
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    byte = alignment._byte_letters()
    a_bytes = [bytes(byte[c] for c in A.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return a, b, a_bytes, b_bytes


def plain(text):
    """(a, b, groups as text, links) by comparing all pairs; None without tokens."""
    if not text:
        return None
    a, b, a_bytes, b_bytes = byte_tokens(text)
    data = (" " + text).encode()
    if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
        return None
    ra, rb = ranges(map(len, a_bytes)), ranges(map(len, b_bytes))
    links = [(a[i], b[j]) for i, (s, e) in enumerate(ra) for j, (u, v) in enumerate(rb) if max(s, u) < min(e, v)]
    cuts = sorted({e for _, e in ra} & {e for _, e in rb})
    groups = [",".join(str(x) for x, (_, e) in zip(a, ra) if low < e <= high) + "|" + ",".join(str(x) for x, (_, e) in zip(b, rb) if low < e <= high)
              for low, high in zip([0, *cuts], cuts)]
    return a, b, groups, links


def plain_rows(rows):
    found = [(i, plain(t)) for i, t in rows]
    count = Counter(pair for _, x in found if x for pair in x[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(str((i, len(x[0]), len(x[1]), len(x[2]), len(x[3]), sum(count[p] == best[p[1]] for p in x[3]), sum(count[p] for p in x[3]),
                       hashlib.sha256(";".join(x[2]).encode()).hexdigest()) if x else (i, 0, 0, 0, 0, 0, 0, "")) for i, x in found)


def texts():
    return [t for t in some_texts(300) + MORE if len(t) < 4000]


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_rows_equal_plain(spark, monkeypatch, bound):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", bound)
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, None), (None, "no id"), (3, "again and again"), (3, "again and again"), (4, "")]
    df = spark.createDataFrame([(i, t, "p", "q", 1, 2) for i, t in rows], SCHEMA).repartition(4)
    assert sorted(str(tuple(r)) for r in aligned_tokens(df, BYTE_BPE, PIECES).collect()) == plain_rows(rows)
    assert aligned_tokens(df.limit(0), BYTE_BPE, PIECES).count() == 0


def test_parts_equal_whole_texts(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_PARTS", 50)
    monkeypatch.setattr(alignment, "PARTS_AT_ONCE", 3)
    own, other = Aligner(BYTE_BPE, PIECES), Aligner(BYTE_BPE, PIECES)
    assert own.parts.findall(" one two\r\n three\n") == [" one", " two\r\n three", "\n"]
    assert own.parts.findall(" it's end.x, (so) ") == [" it's", " end", ".x,", " (so)", " "]
    other.parts = None
    every = texts() * 2
    for k in range(0, len(every), 40):
        for x, y in zip(own.texts(every[k:k + 40]), other.texts(every[k:k + 40])):
            assert (x is None) == (y is None)
            if x:
                assert x[0] == y[0] and x[1].tolist() == y[1].tolist() and dict(zip(x[2].tolist(), x[3].tolist())) == dict(zip(y[2].tolist(), y[3].tolist()))


def test_align_covers_all_overlaps():
    a, b = [2, 3, 1, 4, 2], [1, 1, 2, 6, 1, 1]
    a_to, b_to, link_to, link_a, link_b = align(np.array(a), np.array(b))
    assert list(zip(a_to.tolist(), b_to.tolist(), link_to.tolist())) == [(1, 2, 2), (4, 4, 6), (5, 6, 8)]
    assert list(zip(link_a.tolist(), link_b.tolist())) == [(i, j) for i, (s, e) in enumerate(ranges(a)) for j, (u, v) in enumerate(ranges(b)) if max(s, u) < min(e, v)]
