"""Quality of whole texts by supervised subword embeddings.

Each word has a learned vector of its own and one for each of its character n-grams, found by hash; a word that follows
itself has one more, the same for all words. A document is the mean of all of them, and a softmax over the classes reads it. Both are learned by stochastic gradient descent in numpy on
at most ``TRAIN_ROWS`` labelled documents: those whose hashed doc_id is smallest, so any input gives the same sample.

The mean is linear, so to score a text a table of each bucket's share of the class scores is enough; that table has a
fixed size and travels with the tasks. Every word of every text counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from verdikt.llm.batches import SLICE_BYTES, ranges, slices, split_words, sums, with_text_columns, word_ids, word_ngrams

WORD_BUCKETS, GRAM_BUCKETS, ORDERS = 1 << 16, 1 << 16, (3, 4, 5)
DIM, EPOCHS, RATE, SEED = 12, 6, 1.0, 17
TRAIN_ROWS = 6000
THRESHOLD = 0.3

#: The bucket of a word after itself, and one that every document has, so that an empty one has a vector too.
_REPEAT, _ALWAYS = WORD_BUCKETS + GRAM_BUCKETS, WORD_BUCKETS + GRAM_BUCKETS + 1


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``ids, counts``: buckets of each word, one word after another."""
    grams, owners = word_ngrams(words, ORDERS, GRAM_BUCKETS)
    ids = np.concatenate([word_ids(words, WORD_BUCKETS), WORD_BUCKETS + grams])
    owners = np.concatenate([np.arange(len(words)), owners])
    order = np.argsort(owners, kind="stable")
    return ids[order], np.bincount(owners, minlength=len(words))


def repeats(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often in each document a word follows itself."""
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    same[offsets[:-1][offsets[:-1] < len(codes)]] = False
    return sums(same, offsets)


def _bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's buckets and their shares of the mean; at most one of each bucket, however long the text."""
    for part in slices(batches, "text", SLICE_BYTES // 4):
        offsets, codes, words = split_words(part["text"])
        ids, counts = word_features(words)
        starts = np.cumsum(counts) - counts
        bags = []
        for a, b, again in zip(offsets[:-1], offsets[1:], repeats(codes, offsets)):
            own, times = np.unique(codes[a:b], return_counts=True)
            weight = np.bincount(ids[ranges(starts[own], counts[own])], np.repeat(times, counts[own]), _ALWAYS + 1)
            weight[_REPEAT], weight[_ALWAYS] = again, 1
            found = np.flatnonzero(weight)
            bags.append((found.astype("<i4").tobytes(), (weight[found] / weight.sum()).astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays([part["doc_id"], part["label"], pa.array([x for x, _ in bags], pa.binary()),
                                          pa.array([x for _, x in bags], pa.binary())], ["doc_id", "label", "ids", "shares"])


def descend(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """``embeddings, output``: one document a step, the rate falling to zero in a straight line."""
    rng = np.random.default_rng(SEED)
    embeddings = rng.uniform(-1 / DIM, 1 / DIM, (_ALWAYS + 1, DIM)).astype(np.float32)
    output = np.zeros((DIM, classes), np.float32)
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(bags)):
            ids, shares = bags[k]
            hidden = shares @ embeddings[ids]
            scores = hidden @ output
            slope = np.exp(scores - scores.max())
            slope /= slope.sum()
            slope[labels[k]] -= 1
            slope *= RATE * (1 - done / steps)
            back = output @ slope
            output -= np.outer(hidden, slope)
            embeddings[ids] -= np.outer(shares / shares.max(), back)
            done += 1
    return embeddings, output


def _train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["doc_id"])
    if rows:
        bags = [(np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["shares"], "<f4")) for r in rows]
        embeddings, output = descend(bags, np.array([r["label"] for r in rows]), 2)
        yield pa.RecordBatch.from_arrays([pa.array([(embeddings @ output).astype("<f4").tobytes()])], ["table"])


def remainder(divisor: int) -> Column:
    """crc32 of the doc_id as text, modulo; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Share of each bucket in the scores of class 0 and 1, from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``.

    Rows with a null doc_id or label, or held out, teach nothing. Of several labels of a doc_id the larger counts; of
    several texts one. Without labelled rows every text scores one half.
    """
    chosen = (labels.where((remainder(5) != 0) & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.max("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS))
    # At most TRAIN_ROWS ids are broadcast.
    bags = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
            .mapInArrow(_bags, "doc_id long, label int, ids binary, shares binary")
            .groupBy("doc_id").agg(F.min(F.struct("ids", "shares", "label")).alias("r")).select("doc_id", "r.*"))
    row = bags.coalesce(1).mapInArrow(_train, "table binary").first()
    return np.frombuffer(row.table, "<f4").reshape(-1, 2) if row else np.zeros((_ALWAYS + 1, 2), np.float32)


def score(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, class 1) and ``predicted`` (1 if ``score >= THRESHOLD``) from whole texts.

    A null or empty text is scored like any other, by the share that all documents have.
    """
    edge = (table[:, 1] - table[:, 0]).astype(np.float64)

    def make(texts: pa.Array) -> list[pa.Array]:
        offsets, codes, words = split_words(texts)
        ids, counts = word_features(words)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        again = repeats(codes, offsets)
        total = sums(sums(edge[ids], bounds)[codes], offsets) + again * edge[_REPEAT] + edge[_ALWAYS]
        margin = total / (sums(counts[codes], offsets) + again + 1)
        value = 1 / (1 + np.exp(-margin))
        return [pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))]

    return with_text_columns(docs, make, "score double, predicted int")
