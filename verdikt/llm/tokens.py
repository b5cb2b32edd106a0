"""Texts to token ids by a tokenizer file of the ``tokenizers`` library.

White space separates what a tokenizer of words encodes, so each distinct piece between white space is encoded once and
remembered; a worker forgets when it remembers ``REMEMBERED`` pieces, or more bytes than its caller allows: text without
white space makes every text a piece.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from verdikt.llm.batches import ranges, split_words

REMEMBERED = 250_000
#: Bytes that a remembered piece takes besides its characters and ids.
_ENTRY = 190


class WordTokenizer:
    """Same ids as ``Tokenizer.encode(text, add_special_tokens=False)`` of a tokenizer that drops white space.

    A piece of Latin letters goes to the vocabulary's model directly, lower-cased; any other piece, and any that could
    hold a special token, goes through the whole tokenizer.
    """

    _letters = re.compile("[a-zß-öø-ÿ]+")
    _parts = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
    _plain = re.compile("[!-~À-ÖØ-öø-ÿß]+")

    def __init__(self, path: str, most_bytes: int | None = None) -> None:
        """With ``most_bytes`` what is remembered is bounded by its size, else by its number."""
        self.most_bytes, self.bytes = most_bytes, 0
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.shown = {c: self.whole.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if chr(c).isalpha()}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            shown = piece if piece.isascii() else piece.translate(self.shown)
            got = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            self.bytes += _ENTRY + len(piece) + len(got)
        return got

    def _word(self, word: str) -> bytes:
        low = word.lower()
        if low.isascii():  # most words: letters alone, or with a mark at the end
            if low.isalpha():
                return self._piece(low)
            if low.endswith((".", ",", "!", "?", ";", ":")) and low[:-1].isalpha():
                return self._piece(low[:-1]) + self._piece(low[-1])
        if "<|" not in word and "'" not in word and self._plain.fullmatch(word):
            parts = self._parts.findall(low)
            if all(self._letters.fullmatch(p) or p.isascii() for p in parts):
                return b"".join(map(self._piece, parts))
        return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``ids, counts``: the ids of all texts one after another, and how many each has. A null text is empty."""
        offsets, codes, vocabulary = split_words(texts)
        if len(self.words) + len(self.pieces) > REMEMBERED if self.most_bytes is None else self.bytes > self.most_bytes:
            self.words.clear()
            self.pieces.clear()
            self.bytes = 0
        known, found = self.words, []
        for word in vocabulary.to_pylist():
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self._word(word)
                self.bytes += _ENTRY + 2 * len(word) + len(ids)
            found.append(ids)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), np.uint32)
        per_word = lengths[codes]
        ids = pool[ranges((np.cumsum(lengths) - lengths)[codes], per_word)]
        ends = np.concatenate([[0], np.cumsum(per_word)])[offsets]
        if end is not None:
            ids = np.insert(ids, ends[1:], np.uint32(end))
            ends = ends + np.arange(len(ends))
        return ids, np.diff(ends)


_loaded: dict[tuple[str, int | None], WordTokenizer] = {}


def word_tokenizer(path: str, most_bytes: int | None = None) -> WordTokenizer:
    """One for each file, bound and worker process."""
    if (path, most_bytes) not in _loaded:
        _loaded[path, most_bytes] = WordTokenizer(path, most_bytes)
    return _loaded[path, most_bytes]
