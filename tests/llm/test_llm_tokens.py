"""Token counts, packing and binary records against the tokenizers library and plain Python."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from geoloom.llm.bpe import Ids
from geoloom.llm.packing import assign, pack
from geoloom.llm.queries import BYTE_BPE, WORD_BPE
from geoloom.llm.records import frame, parse, read_shuffled, scan_records, token_records
from geoloom.llm.token_counts import MergeCounter, token_counts

BYTES, WORDS = Tokenizer.from_file(BYTE_BPE), Tokenizer.from_file(WORD_BPE)
TEXTS = ["", " ", "  ", "\n", "a", " a", "a ", "Hello world", "two  spaces", "tab\tand\n\nlines \n end\n", "it's we'll I'd THEY'RE", "123 4567,89.0",
         "<|endoftext|>", "x<|endoftext|> y <|startoftext|>z", "naïve Σίσυφος ΣΑΣ İstanbul ǅ", "ñ é é ́x", "日本語 テキスト", "a b c\u0085d",
         "\x1c\x1d x \x1f", "᠎ y", "🙂🙂 ok", "### *** $$$ a|b", "aaaaaaaaaaaaaaaaaaaa " * 3, "word " * 3000]
ALPHABET = ["a", "b", "th", "ing", " ", " ", "  ", "\n", "\t", "'s", "1", "É", "ß", ",", ".", "!", " ", "🙂", "<|endoftext|>", "́", "Σ"]


def some_texts(n=400):
    draw = random.Random(5)
    return TEXTS + ["".join(draw.choices(ALPHABET, k=draw.randrange(1, 40))) for _ in range(n)]


def ids_of(text):
    return np.array(BYTES.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


@pytest.fixture(scope="module")
def edge_docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(some_texts(60))] + [(None, None, "n"), (3, "again", "r"), (3, "again", "r"), (None, "no id", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, path string").repartition(3)


def test_ids_equal_the_library():
    texts = some_texts()
    found = Ids(BYTE_BPE).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [BYTES.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_odd_pieces_equal_the_library_over_generations(monkeypatch):
    monkeypatch.setattr("geoloom.llm.bpe.KEPT_WORDS", 400)  # words go over to a new generation again and again
    draw, ids = random.Random(5), Ids(BYTE_BPE)
    pieces = ["a", "b", "the", "é", "ß", "Ж", "中", "e\u0301", "Ա", "'s", "'", "1", "42", "²", "Ⅷ", ".", " ", " ", "  ", "\n", "\n", "\n\n", "\t",
              "\r\n", "\x1c", "\u180e", "\u3000", "\xa0", "-", "<|endoftext|>", "<|", "Ċ", "Ġ", "ĊĠx", "ʰ", "_", "?\n", "\u200b", "😀"]
    for _ in range(400):
        texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 30))) for _ in range(5)]
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.encode(texts)] == [BYTES.encode(t, add_special_tokens=False).ids for t in texts]


def test_counts_equal_the_library():
    count = MergeCounter(WORD_BPE)
    for text in some_texts():
        assert count.count(text) == len(WORDS.encode(text, add_special_tokens=False).ids), repr(text)


def test_token_counts(edge_docs):
    rows, df = edge_docs
    want = sorted((str(i), len((t or "").encode()), n := len(WORDS.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, WORD_BPE, 100).collect()) == want


def test_assign_is_balanced_and_full():
    draw = random.Random(1)
    lengths = [draw.choice([1, 2, 30, 200, 900, 1024, 1025, 5000]) for _ in range(300)]
    pieces = assign(lengths)
    by_doc, by_seq = {}, {}
    for doc, at, n, s, offset in pieces:
        by_doc.setdefault(doc, []).append((at, n))
        by_seq.setdefault(s, []).append((offset, n))
    for parts, total in [*((by_doc[d], n) for d, n in enumerate(lengths)), *((p, None) for p in by_seq.values())]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == total if total is not None else at <= 1024
    assert len(by_seq) == -(-sum(lengths) // 1024)
    assert assign([]) == []


def test_pack(edge_docs, spark):
    rows, df = edge_docs
    found = pack(df, BYTE_BPE, block_tokens=500).collect()
    assert sum(r.length for r in found) == sum(len(ids_of(t)) for _, t, _ in rows)
    texts = {i: ids_of(t) for i, t, _ in rows if i is not None and i != 3}
    for r in found:
        if r.doc_id in texts:
            assert r.doc_tokens == len(texts[r.doc_id])
            assert r.ids_crc32 == zlib.crc32(texts[r.doc_id][r.start:r.start + r.length].tobytes())
    by_seq = {}
    for r in found:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        assert sum(n for _, n in parts) <= 1024
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
    assert pack(df.limit(0), BYTE_BPE).count() == 0


def test_frames():
    for doc_id, width in ((7, 2), (None, 4), (-1, 2)):
        data = frame(doc_id, np.array([1, 2, 50256], "<u4"), width)
        got, ids, end = parse(b"xx" + data, 2)
        assert (got, ids.tolist(), end) == (doc_id, [1, 2, 50256], len(data) + 2)
        for at in (0, 9, 20, len(data) - 1):
            damaged = bytearray(data)
            damaged[at] ^= 1
            with pytest.raises(ValueError):
                parse(bytes(damaged), 0)


def test_records(edge_docs, spark, tmp_path):
    rows, df = edge_docs
    found = sorted(token_records(df, BYTE_BPE, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    order = [(-1 if r.doc_id is None else r.doc_id) for r in found]
    assert order == sorted(order)
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    want = sorted((str(i), len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == want

    index = scan_records(spark, str(tmp_path / "a/data"))
    first = [tuple(r) for r in read_shuffled(spark, index, str(tmp_path / "a/data"), 1).collect()]
    other = [tuple(r) for r in read_shuffled(spark, index, str(tmp_path / "a/data"), 2).collect()]
    assert first != other and sorted(map(str, first)) == sorted(map(str, other))
    assert sorted(str(i) for i, _, _ in first) == sorted(str(i) for i, *_ in rows)


def test_records_of_an_empty_table(edge_docs, tmp_path):
    assert token_records(edge_docs[1].limit(0), BYTE_BPE, str(tmp_path / "e")).count() == 0
