"""Byte-level ids of whole texts by the tokenizers library, word by word with a bounded memory of words.

A byte-level pre-tokenizer never joins a space to what stands before it, so a text may be cut before every single space
that a non-space follows, and each piece encoded alone. Pieces repeat, so most are looked up.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

KEPT_WORDS = 300_000  # pieces remembered in a Python worker, half of them of the generation before
# Pieces that can't stand alone: none or white space after the space, control characters on which regex engines differ, special tokens.
_ALONE = re.compile(r"\A(?:[^\S\x1c]|\Z)|.[\x1c-\x1f\u180e]|\A[\x1d-\x1f\u180e]|<\|", re.DOTALL)
_ODD = re.compile(r"[\x1c-\x1f\u180e]|<\|")
_CUT = "\x1c"  # stands for a newline before a word where texts are split; texts that hold one are encoded whole
_LINE = re.compile(r"\n(?=\S)")  # whatever space comes before it is cut off there too
_PIECES = re.compile(r"[ \n]?\S+|\s+(?!\S)|\s+")
_SCRIPTS = "\u0530"  # below this no letter is younger than any regex engine's tables
_MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"  # none of these joins a letter before it

# Bytes are written as characters: printable ones as themselves, the others as those from 256 on in their order.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Ids:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer.from_file(path)  # takes words in the vocabulary's own characters, with no pattern to match
        self.letters.pre_tokenizer = pre_tokenizers.Split(_BYTES[ord("\n")], "isolated")
        self.spaced: dict[str, bytes] = {}  # ids of " " + key
        self.plain: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}  # the generation before, of both
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def _each(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _lines(self, words: list[str], lead: str, known: dict[str, bytes], encode) -> None:
        """Many words are encoded as one text of lines and cut at the newlines' ids."""
        for k in range(0, len(words), 4096):
            part = words[k:k + 4096]
            ids = np.array(encode(lead + ("\n" + lead).join(part)), "<u4")
            cuts = np.flatnonzero(ids == self.newline[0])
            if len(cuts) == len(part) - 1:  # the ids between newlines, four bytes each
                data, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                known.update(zip(part, [data[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends)]))

    def _by_letters(self, text: str) -> list[int]:
        """Ids of lines of letters: each is one pre-token, so only the model has work to do."""
        written = text.encode().decode("latin-1").translate(_BYTES)
        return self.letters.encode_batch_fast([written], add_special_tokens=False)[0].ids

    def _by_pattern(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _stems(self, stems: list[str], lead: str, known: dict[str, bytes]) -> None:
        if len(self.newline) == 1:
            letters = [w for w in stems if w.isalpha() and (w.isascii() or max(w) < _SCRIPTS)]
            self._lines(letters, lead, known, self._by_letters)
            self._lines([w for w in stems if w not in known and "\n" not in w and not w[-1].isspace()], lead, known, self._by_pattern)
        rest = [w for w in stems if w not in known]
        known.update(zip(rest, self._each([lead + w for w in rest])))

    def _words(self, words: set[str], lead: str, known: dict[str, bytes]) -> None:
        """Marks after a letter are a piece of their own, so words are learned without and get the marks' ids behind."""
        plain, marked = self.plain, []
        stems = {w for w in words if w.isalpha()}
        for w in words - stems:
            bare = w.rstrip(_MARKS)
            if len(bare) < len(w) and bare and bare[-1].isalpha():
                marked.append((bare, w))
                stems.add(bare)
            else:
                stems.add(w)
        self._stems(list(stems.difference(known)), lead, known)
        for bare, w in marked:
            tail = w[len(bare):]
            if tail not in plain:
                plain[tail] = self._each([tail])[0]
            known[w] = known[bare] + plain[tail]

    def _learn(self, words: set[str]) -> None:
        """What begins with a cut is a newline, a piece of its own, and a word without a space."""
        spaced, plain = self.spaced, self.plain
        lines = {w for w in words if w[0] == _CUT}
        self._words(words - lines, " ", spaced)
        self._words({w[1:] for w in lines}.difference(plain), "", plain)
        newline = np.array(self.newline, "<u4").tobytes()
        spaced.update((w, newline + plain[w[1:]]) for w in lines)

    def _recall(self, words, known: dict[str, bytes], older: dict[str, bytes]) -> set[str]:
        """Words that neither generation knows; those of the older one go over to the newer one."""
        missing = words.difference(known)
        again = missing.intersection(older)
        known.update((w, older[w]) for w in again)
        return missing - again

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.spaced) + len(self.plain) > KEPT_WORDS // 2:
            self.older, self.spaced, self.plain = (self.spaced, self.plain), {}, {}
        spaced, plain = self.spaced, self.plain
        split = [_LINE.sub(" " + _CUT, text).split(" ") if _CUT not in text else [] for text in texts]
        new = self._recall(set().union(*split), spaced, self.older[0])
        bad = {w for w in new if not w.isalpha() and _ALONE.search(w)}
        self._learn(new - bad)
        out, uneven, whole = [b""] * len(texts), {}, []
        for i, words in enumerate(split):
            if not words:
                whole.append(i)
            elif bad and not bad.isdisjoint(words) and (_ODD.search(texts[i]) or not bad.isdisjoint(words[1:])):
                if _ODD.search(texts[i]):
                    whole.append(i)
                else:
                    uneven[i] = _PIECES.findall(texts[i])
        first = {words[0] for words in split if words}
        pieces = list(self._recall(first.union(*uneven.values()), plain, self.older[1]))
        plain.update(zip(pieces, self._each(pieces)))
        whole_ids = dict(zip(whole, self._each([texts[i] for i in whole])))
        for i, words in enumerate(split):
            if i in uneven:
                out[i] = b"".join([plain[p] for p in uneven[i]])
            elif i in whole_ids:
                out[i] = whole_ids[i]
            else:
                parts = [plain[words[0]], *map(spaced.__getitem__, words[1:])]  # no space stands before the first
                out[i] = b"".join(parts)
        return out


@lru_cache(2)
def encoder(path: str) -> Ids:
    """One encoder a Python worker and vocabulary file."""
    return Ids(path)


def encoded(batches, path: str, block_chars: int = 4_000_000):
    """(doc ids, ids of each document) of Arrow batches with doc_id and text, in blocks of bounded size."""
    ids = encoder(path)
    for batch in batches:
        docs, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
        at = 0
        while at < len(docs):
            end, size = at, 0
            while end < len(docs) and (end == at or size + len(texts[end]) <= block_chars):
                size += len(texts[end])
                end += 1
            yield docs[at:end], ids.encode(texts[at:end])
            at = end
