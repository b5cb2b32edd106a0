"""Language of whole texts by error-correcting output codes.

Each language has a codeword; a linear classifier over hashed character n-grams predicts each of its bits. A text takes
the language whose codeword is nearest, where a bit costs the logistic loss of its classifier against the word's bit,
weighted by how often that classifier is right. If the second nearest is nearly as near, the text is marked ambiguous.

Learning takes at most ``TRAIN_ROWS`` documents a language, those whose hashed doc_id is smallest.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from verdikt.llm.batches import SLICE_BYTES, ranges, slices, split_words, sums, with_text_columns, word_ngrams
from verdikt.llm.quality import remainder

BUCKETS, ORDERS = 1 << 12, (1, 2, 3, 4)
TRAIN_ROWS, STEPS, RATE, SEED = 1000, 150, 0.05, 23
#: A text is ambiguous if the two best languages' shares differ by less.
AMBIGUOUS = 0.05
UNDETERMINED = "und"


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray     # languages x bits, -1 or 1
    weights: np.ndarray   # buckets x bits
    bias: np.ndarray      # bits
    trust: np.ndarray     # bits, mean 1


def codewords(count: int) -> np.ndarray:
    """A row a language. All splits of up to six languages into two camps; beyond, the best spread of random words tried."""
    if count <= 6:
        bits = range(1, 1 << max(count - 1, 0))
        return np.array([[1 if k == 0 or not b >> (k - 1) & 1 else -1 for b in bits] for k in range(count)], np.int8).reshape(count, -1)
    rng, best, spread = np.random.default_rng(SEED), None, -1
    for _ in range(50):
        words = rng.choice(np.array([-1, 1], np.int8), (count, math.ceil(10 * math.log2(count))))
        apart = words.astype(np.int32) @ words.T
        np.fill_diagonal(apart, -words.shape[1])
        nearest = (words.shape[1] - apart.max()) / 2
        if nearest > spread and (np.abs(words.sum(axis=0, dtype=np.int64)) < count).all():
            best, spread = words, nearest
    if best is None:
        raise ValueError(f"no codewords for {count} languages")
    return best


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``offsets, codes`` of the words of lower-cased texts, and ``ids, counts`` of each word's n-grams."""
    offsets, codes, words = split_words(pc.utf8_lower(texts))
    ids, owners = word_ngrams(words, ORDERS, BUCKETS)
    order = np.argsort(owners, kind="stable")
    return offsets, codes, ids[order], np.bincount(owners, minlength=len(words))


def _profiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Share of each bucket among a document's n-grams: a vector of fixed size."""
    for part in slices(batches, "text", SLICE_BYTES // 4):
        offsets, codes, ids, counts = _features(part["text"])
        starts, out = np.cumsum(counts) - counts, []
        for a, b in zip(offsets[:-1], offsets[1:]):
            own, times = np.unique(codes[a:b], return_counts=True)
            share = np.bincount(ids[ranges(starts[own], counts[own])], np.repeat(times, counts[own]), BUCKETS)
            out.append((share / max(1, share.sum())).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([part["doc_id"], part["lang"], pa.array(out, pa.binary())], ["doc_id", "lang", "profile"])


def learn(profiles: np.ndarray, classes: np.ndarray, languages: list[str]) -> Model:
    """Logistic regression of all bits at once by Adam; the last tenth of the rows tells how far to trust each bit."""
    codes = codewords(len(languages))
    bits = codes.shape[1]
    order = np.random.default_rng(SEED).permutation(len(profiles))
    tune, held = order[len(order) // 10:], order[:len(order) // 10]
    scale = np.sqrt((profiles ** 2).mean(axis=0)) + 1e-4
    x, y = profiles[tune] / scale, codes[classes[tune]].astype(np.float32)
    # Languages weigh alike, however many rows each has.
    share = (1 / np.bincount(classes[tune], minlength=len(languages)).clip(1))[classes[tune]]
    share = (share / share.sum()).astype(np.float32)[:, None]
    weights, bias = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        pull = -y * share / (1 + np.exp(np.clip(y * (x @ weights + bias), -30, 30)))
        slope = x.T @ pull + 1e-5 * weights
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope ** 2
        weights -= RATE * mean / (1 - 0.9 ** step) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
        bias -= RATE * pull.sum(axis=0)
    wrong = (codes[classes[held]] * (profiles[held] / scale @ weights + bias) <= 0).mean(axis=0) if len(held) else np.zeros(bits)
    trust = np.log((1 - np.clip(wrong, 0.005, 0.45)) / np.clip(wrong, 0.005, 0.45))
    model = Model(languages, codes, (weights / scale[:, None]).astype(np.float64), bias.astype(np.float64), trust / trust.mean() if bits else trust)
    if not len(held) or not bits:
        return model

    def surprise(heat: float) -> float:
        cooled = model._replace(bias=model.bias / heat)
        loss = _losses(cooled, profiles[held] @ model.weights / heat + cooled.bias)
        return (loss[np.arange(len(held)), classes[held]] + np.log(np.exp(-loss).sum(axis=1))).sum()

    # Weights fitted closely are too sure of texts not seen; the held rows say by how much.
    heat = min((2.0 ** k for k in range(9)), key=surprise)
    return model._replace(weights=model.weights / heat, bias=model.bias / heat)


def _losses(model: Model, outputs: np.ndarray) -> np.ndarray:
    return np.stack([(model.trust * np.logaddexp(0, -outputs * word)).sum(axis=1) for word in model.codes], axis=1)


def decode(model: Model, outputs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best, share, lead``: number of the nearest codeword, its share of all, and how far that is above the next."""
    loss = _losses(model, outputs)
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    top = share[np.arange(len(share)), best]
    share[np.arange(len(share)), best] = -1
    return best, top, top - np.maximum(share.max(axis=1), 0)


def fit(docs: DataFrame) -> Model:
    """Learns from ``docs(doc_id, text, lang)`` where lang is known and crc32(doc_id as text) mod 3 is not 1."""
    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["lang"], r["doc_id"]))
        if rows:
            profiles = np.stack([np.frombuffer(r["profile"], "<f4") for r in rows])
            m = learn(profiles, np.array([languages.index(r["lang"]) for r in rows]), languages)
            yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()]), pa.array([m.bias.tobytes()]), pa.array([m.trust.tobytes()])],
                                             ["weights", "bias", "trust"])

    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(
        (remainder(3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    # Twice as many as are wanted pass by a fraction of the hash range, so that no task ranks a whole language.
    part = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, 2 * TRAIN_ROWS / n))) for x, n in counts.items()], F.lit(0.0))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "t"))
    rows = (known.withColumn("h", F.xxhash64("doc_id")).withColumn("t", F.xxhash64("text"))
            .where(F.col("h") <= F.lit(-2.0 ** 63) + part * 2.0 ** 64))
    chosen = rows.select("lang", "doc_id", "t", "h").withColumn("k", place).where(F.col("k") <= TRAIN_ROWS).select("doc_id", "t", "lang").distinct()
    # At most TRAIN_ROWS rows a language are broadcast.
    picked = (rows.join(F.broadcast(chosen), ["doc_id", "t", "lang"], "left_semi").dropDuplicates(["doc_id", "t", "lang"])
              .select("doc_id", "text", "lang").mapInArrow(_profiles, "doc_id long, lang string, profile binary"))
    found = picked.coalesce(1).mapInArrow(train, "weights binary, bias binary, trust binary").first() if counts else None
    if not found:
        return Model([], np.zeros((0, 0), np.int8), np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(0))
    codes = codewords(len(languages))
    return Model(languages, codes, np.frombuffer(found.weights).reshape(BUCKETS, -1), np.frombuffer(found.bias), np.frombuffer(found.trust))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``, from whole texts.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing could be learned. With
    one language known, every other text has it, with score 1. Of equally near languages the first by name is taken.
    """
    names = np.array([*model.languages, UNDETERMINED], object)

    def make(texts: pa.Array) -> list[pa.Array]:
        offsets, codes, ids, counts = _features(texts)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        n = sums(counts[codes], offsets)
        if model.bias.size:
            # Bit by bit: all bits of all n-grams at once would be the largest thing in the task.
            outputs = np.stack([sums(sums(column[ids], bounds)[codes], offsets) for column in model.weights.T], axis=1)
            outputs = outputs / np.maximum(n, 1)[:, None] + model.bias
            best, share, lead = decode(model, outputs)
        else:
            best, share, lead = np.zeros(len(texts), np.int64), np.ones(len(texts)), np.ones(len(texts))
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        lost = ~letters | (not model.languages)
        return [pa.array(names[np.where(lost, len(names) - 1, best)], pa.string()), pa.array(np.where(lost, 0.0, share)),
                pa.array(lost | (lead < AMBIGUOUS))]

    return with_text_columns(docs, make, "lang_pred string, score double, ambiguous boolean")
