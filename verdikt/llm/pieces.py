"""SentencePiece encoding by Viterbi over shared prefixes, and decoding.

A text is marked as SentencePiece marks it: one blank in front, blanks as U+2581. No piece runs over the beginning of a
word's marks, so a text's best segmentation is that of its marked words one by one. Distinct new words of a slice are
sorted, which lays them out as a trie in depth-first order: the path to a word is shared with the word before up to their
common prefix, and so are the forward scores there; only the rest of each word is scored. Encoded words are remembered
until there are ``REMEMBERED``.

The segmentation is the one with the greatest sum of the scores in the model file, for which longer first pieces win
ties; a character in no piece is its UTF-8 bytes' pieces. For a file whose scores are merge ranks this is not the order of
merges: it is what SentencePiece gives if such a file is declared a unigram model.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from verdikt.llm.batches import ranges, with_text_columns

REMEMBERED = 400_000

# Fixed values of the format.
MARK = "▁"
UNKNOWN_PENALTY = 10.0

_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Pieces:
    """Vocabulary of a model file."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.scores: dict[str, tuple[float, int]] = {}
        self.bytes = [-1] * 256
        self.surface = [b""] * size
        for k in range(size):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
                self.surface[k] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k)):
                self.surface[k] = piece.replace(MARK, " ").encode()
                if not model.is_unused(k):
                    self.scores[piece] = (model.get_score(k), k)
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("a piece of this model runs over the beginning of a word")
        self.unknown = model.unk_id()
        self.worst = min((s for s, _ in self.scores.values()), default=0.0) - UNKNOWN_PENALTY
        lengths: dict[str, set[int]] = {}
        for piece in self.scores:
            lengths.setdefault(piece[-1], set()).add(len(piece))
        #: By last character, how long pieces can be, the longest first.
        self.lengths = {c: sorted(n, reverse=True) for c, n in lengths.items()}
        self.known: dict[str, bytes] = {}

    def _fallback(self, char: str) -> list[int]:
        found = [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown] if min(found) < 0 else found

    def segment(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct marked words, by one walk over their trie."""
        out: dict[str, list[int]] = {}
        best, back = [0.0], [(0, -1)]      # of each prefix of the path: its score, and its last piece's length and id
        before = ""
        scores, lengths, worst = self.scores, self.lengths, self.worst
        for word in sorted(words):
            shared, limit = 0, min(len(word), len(before))
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1:], back[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                top, last = best[end - 1] + worst, (1, -1)
                for n in lengths.get(word[end - 1], ()):
                    if n <= end:
                        found = scores.get(word[end - n:end])
                        if found is not None and (value := best[end - n] + found[0]) > top:
                            top, last = value, (n, found[1])
                best.append(top)
                back.append(last)
            ids, end = [], len(word)
            while end:
                n, piece = back[end]
                ids.extend([piece] if piece >= 0 else reversed(self._fallback(word[end - 1])))
                end -= n
            ids.reverse()
            out[word] = ids
            before = word
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``ids, offsets`` of all texts. Null and empty texts have none."""
        offsets, codes, words = marked_words(texts)
        words = words.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        self.known.update((w, array("i", ids).tobytes()) for w, ids in self.segment(new).items())
        found = [self.known[w] for w in words]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), np.int32)
        counts = lengths[codes]
        return pool[ranges((np.cumsum(lengths) - lengths)[codes], counts)], np.concatenate([[0], np.cumsum(counts)])[offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of runs of ids. Bytes that are no UTF-8 become U+FFFD; control ids are silent."""
        lengths = np.fromiter(map(len, self.surface), np.int64, len(self.surface))
        pool = np.frombuffer(b"".join(self.surface), np.uint8)
        counts = lengths[ids]
        data = pool[ranges((np.cumsum(lengths) - lengths)[ids], counts)].tobytes()
        ends = np.concatenate([[0], np.cumsum(counts)])[offsets]
        return [data[a + (data[a:a + 1] == b" "):b].decode("utf-8", "replace") if b > a else "" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def marked_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``offsets, codes, words``: marked words of texts, each distinct one once."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
    empty = pc.equal(texts, "")
    # Single blanks inside: splitting there and marking each part is all there is to do.
    lists = pc.split_pattern(texts, " ")
    values = lists.values
    encoded = values.dictionary_encode()
    words = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), encoded.dictionary, pa.scalar("", pa.large_string()))
    offsets, codes = lists.offsets.to_numpy().astype(np.int64), encoded.indices.to_numpy().astype(np.int64)
    if not (pc.any(odd).as_py() or pc.any(empty).as_py()):
        return offsets, codes, words
    numbers = {w: k for k, w in enumerate(words.to_pylist())}
    parts = [codes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
        parts[k] = np.array([numbers.setdefault(w, len(numbers)) for w in _WORDS.findall(MARK + texts[int(k)].as_py().replace(" ", MARK))], np.int64)
    for k in np.flatnonzero(empty.to_numpy(zero_copy_only=False)):
        parts[k] = np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts), pa.array(list(numbers), pa.large_string())


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One for each file and worker process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids``, the pieces of each whole ``text``; an empty list for a null or empty one."""
    return with_text_columns(docs, lambda texts: [_lists(*pieces(path).encode(texts))], "ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` with ``text`` made from ``ids``; null for null ids."""
    kept = coded.drop("text")
    schema = StructType([*kept.schema.fields, StructField("text", StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                lists = part["ids"]
                ids = pc.fill_null(lists.flatten(), pieces(path).unknown).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
                texts = pa.array(pieces(path).decode(ids, ends), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pc.if_else(pc.is_valid(lists), texts, None)], [*part.schema.names, "text"])

    return kept.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens``, ``ids_crc32`` (of little-endian 32-bit ids) and ``exact``: decoding gives the text back.

    ``exact`` is false only for texts with a U+2581 of their own, which reads as a blank; a null text counts as empty.
    """
    def make(texts: pa.Array) -> list[pa.Array]:
        book = pieces(path)
        ids, offsets = book.encode(texts)
        back = book.decode(ids, offsets)
        same = [a == (b or "") for a, b in zip(back, texts.to_pylist())]
        sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        return [_lists(ids, offsets), pa.array(np.diff(offsets)), pa.array(sums, pa.int64()), pa.array(same)]

    return with_text_columns(docs, make, "ids array<int>, n_tokens long, ids_crc32 long, exact boolean")
