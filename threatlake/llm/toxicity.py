"""Toxicity from subword-bag embeddings, averaged and put through a linear softmax.

A word is the mean of the vectors of its character n-grams (of bytes, with marks for its ends),
a text the mean of its words. Vectors and softmax are trained together in numpy; words never
seen, misspelt ones among them, get their score from n-grams that they share with known ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.llm.pretokens import Splitter, Words, batched
from threatlake.session import materialise

#: Labelled rows that are learnt from: at most so many of label 0 and of label 1, chosen by a hash of the id.
TRAIN_ROWS = (4000, 2000)
#: One in so many of them is kept from the vectors, to set the scale of the scores.
CALIBRATION = 4
#: N-grams are hashed to so many vectors of so many numbers.
BUCKETS, DIMENSIONS = 1 << 18, 8
#: Three is the least: a word of one letter, with its marks, has to have one.
NGRAMS = (3, 4, 5)
STEPS, RATE, MOMENTUM, DECAY = 120, 0.1, 0.9, 1e-2
#: Words of fewer texts of the sample add to a text's length only.
LEAST_TEXTS = 3


@dataclass
class Bags:
    """Texts as word counts: for each word of a text its number, the word's, and how often."""

    words: list[bytes]
    doc: np.ndarray
    word: np.ndarray
    count: np.ndarray
    size: np.ndarray  # words of each text

    def of(self, chosen: np.ndarray) -> Bags:
        """The texts for which ``chosen`` holds, numbered anew."""
        own = chosen[self.doc]
        return Bags(self.words, (np.cumsum(chosen) - 1)[self.doc[own]], self.word[own], self.count[own], self.size[chosen])


@dataclass
class Model:
    """``worth``: what a bucket adds to the log-odds; ``bias``: where they start."""

    worth: np.ndarray
    bias: float

    def word_worth(self, words: Words, which: np.ndarray) -> np.ndarray:
        out = np.zeros(len(which))
        for own, buckets, valid in _grams(words, which):
            out[own] = (self.worth[buckets] * valid).sum(axis=1) / np.maximum(1, valid.sum(axis=1))
        return out

    def bag_worths(self, bags: Bags) -> np.ndarray:
        worth = self.word_worth(_as_words(bags.words), np.arange(len(bags.words)))
        total = np.bincount(bags.doc, weights=worth[bags.word] * bags.count, minlength=len(bags.size))
        return total / np.maximum(1, bags.size)

    def score(self, splitter: Splitter, texts: list[str]) -> np.ndarray:
        """Probabilities of label 1. A text without words gets that of the bias alone."""
        words = splitter.split([t.lower() for t in texts])
        _, which, place = words.distinct()
        worth = self.word_worth(words, which)[place] if len(place) else np.zeros(0)
        total = np.bincount(words.text, weights=worth, minlength=len(texts))
        n = np.bincount(words.text, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(1, n), -500, 500)))


def _as_words(coded: list[bytes]) -> Words:
    last = np.cumsum([len(w) for w in coded], dtype=np.int64)
    return Words(last, last - np.array([len(w) for w in coded], np.int64), last, last, np.frombuffer(b"".join(coded), np.uint8))


def _grams(words: Words, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in ``which``, buckets, mask) of the n-grams of words, in groups of like length."""
    size = words.last[which] - words.first[which]
    low, width = 0, 8
    while low < size.max(initial=0):
        own = np.flatnonzero((size > low) & (size <= width))
        for k in range(0, len(own), step := max(1, 400_000 // width)):
            part = own[k:k + step]
            n, first = size[part][:, None], words.first[which[part]][:, None]
            cols = np.arange(width + 2)
            letters = words.data[np.clip(first + cols - 1, 0, len(words.data) - 1)].astype(np.uint64)
            letters = np.where(cols == 0, np.uint64(ord("<")), np.where(cols == n + 1, np.uint64(ord(">")), letters))
            buckets, valid = [], []
            with np.errstate(over="ignore"):
                for length in NGRAMS:
                    if length > width + 2:
                        continue
                    hashes = np.full((len(part), width + 3 - length), length, np.uint64)
                    for j in range(length):
                        hashes = (hashes ^ letters[:, j:j + hashes.shape[1]]) * np.uint64(0x9E3779B97F4A7C15)
                        hashes ^= hashes >> np.uint64(29)
                    buckets.append((hashes % np.uint64(BUCKETS)).astype(np.int64))
                    valid.append(cols[:hashes.shape[1]] + length <= n + 2)
            yield part, np.concatenate(buckets, axis=1), np.concatenate(valid, axis=1)
        low, width = width, width * 2


def _rows_mean(values: np.ndarray, weights: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Weighted sums of consecutive rows; every group has one row at least."""
    return np.add.reduceat(values * weights[:, None], begins, axis=0)


def calibrated(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton's method with a light ridge."""
    scale = float(np.abs(margins).mean()) + 1e-9
    x = np.stack([margins / scale, np.ones(len(margins))], axis=1)
    weights = weights / weights.mean()
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (p - labels)) + 0.1 * (beta - [1.0, 0.0]) * [1, 0]
        curve = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag([0.1, 1e-6])
        step = np.linalg.solve(curve, slope)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-6) / scale, float(beta[1])


def train(bags: Bags, labels: np.ndarray, weights: np.ndarray) -> Model:
    """The model of all but each CALIBRATION-th text, its scale set on those."""
    labels, weights = np.asarray(labels, np.float64), np.asarray(weights, np.float64)
    apart = np.arange(len(labels)) % CALIBRATION == CALIBRATION - 1
    model = fit(bags.of(~apart), labels[~apart], weights[~apart])
    if len(set(labels[apart].tolist())) < 2:
        return model
    slope, offset = calibrated(model.bias + model.bag_worths(bags.of(apart)), labels[apart], weights[apart])
    return Model(model.worth * slope, model.bias * slope + offset)


def fit(bags: Bags, labels: np.ndarray, weights: np.ndarray, seed: int = 0) -> Model:
    """Fit on bags of words; ``weights`` bring the labels back to their shares among all rows.

    Words of fewer than LEAST_TEXTS texts of the sample add to their length only. An n-gram's
    step is its gradient in units of what chance gives an n-gram of its frequency. With one
    label there is nothing to learn but its share.
    """
    share = float(np.clip((labels @ weights) / max(weights.sum(), 1e-9), 1e-3, 1 - 1e-3)) if len(labels) else 0.05
    bias = float(np.log(share / (1 - share)))
    known = np.bincount(bags.word, minlength=len(bags.words)) >= LEAST_TEXTS
    if not known.any() or len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), bias)
    coded = [w for w, k in zip(bags.words, known.tolist()) if k]
    words = _as_words(coded)
    word_of, bucket_of, part_of = [], [], []
    for own, buckets, valid in _grams(words, np.arange(len(coded))):
        r, c = np.nonzero(valid)
        word_of.append(own[r])
        bucket_of.append(buckets[r, c])
        part_of.append(1 / valid.sum(axis=1)[r])
    word_of, bucket_of, part_of = (np.concatenate(x) for x in (word_of, bucket_of, part_of))
    order = np.argsort(word_of, kind="stable")
    word_of, bucket_of, part_of = word_of[order], bucket_of[order], part_of[order].astype(np.float32)
    used, bucket_of = np.unique(bucket_of, return_inverse=True)
    word_begins = np.flatnonzero(np.append(True, word_of[1:] != word_of[:-1]))
    by_bucket = np.argsort(bucket_of, kind="stable")
    bucket_begins = np.flatnonzero(np.append(True, bucket_of[by_bucket][1:] != bucket_of[by_bucket][:-1]))
    # Texts: one row for each word of theirs that is known.
    own = known[bags.word]
    kept, doc_of = np.unique(bags.doc[own], return_inverse=True)
    its_word = (np.cumsum(known) - 1)[bags.word[own]]
    its_part = (bags.count[own] / bags.size[bags.doc[own]]).astype(np.float32)
    doc_begins = np.flatnonzero(np.append(True, doc_of[1:] != doc_of[:-1]))
    by_word = np.argsort(its_word, kind="stable")
    seen_words, word_heads = np.unique(its_word[by_word], return_index=True)
    y, weight = labels[kept], (weights[kept] / weights[kept].sum())

    def back(by_doc: np.ndarray) -> np.ndarray:
        """What documents' vectors owe to each bucket, summed."""
        by_its_word = np.zeros((len(coded), by_doc.shape[1]), np.float32)
        by_its_word[seen_words] = _rows_mean(by_doc[doc_of[by_word]], its_part[by_word], word_heads)
        return _rows_mean(by_its_word[word_of[by_bucket]], part_of[by_bucket], bucket_begins)

    # Variance of a gradient by chance: weights squared, and a part of a text as often as it is in one.
    chance = np.sqrt(back((weight ** 2 / bags.size[kept]).astype(np.float32)[:, None])) + 1e-9
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((len(used), DIMENSIONS)) * 0.1).astype(np.float32)
    softmax = (rng.standard_normal((DIMENSIONS, 2)) * 0.1).astype(np.float32)
    offset = np.array([-bias / 2, bias / 2], np.float32)
    speed_v, speed_s, speed_o = np.zeros_like(vectors), np.zeros_like(softmax), np.zeros_like(offset)
    target = np.stack([1 - y, y], axis=1)
    for _ in range(STEPS):
        word_vectors = _rows_mean(vectors[bucket_of], part_of, word_begins)
        doc_vectors = _rows_mean(word_vectors[its_word], its_part, doc_begins)
        z = doc_vectors @ softmax + offset
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = ((p - target) * weight[:, None]).astype(np.float32)
        grad_s, grad_o = doc_vectors.T @ slope, slope.sum(axis=0)
        grad_v = back(slope @ softmax.T) / chance
        for value, speed, grad in ((vectors, speed_v, grad_v), (softmax, speed_s, grad_s), (offset, speed_o, grad_o)):
            # Steps of one size whatever the scale: strong n-grams move more than weak ones.
            largest = float(np.sqrt((grad ** 2).max())) + 1e-12
            speed *= MOMENTUM
            speed -= RATE * grad / largest * (0.2 if value is not vectors else 1)
            value += speed
            value *= 1 - (DECAY if value is vectors else 0)
    worth = np.zeros(BUCKETS)
    worth[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return Model(worth, float(offset[1] - offset[0]))


def bags(splitter: Splitter, texts: list[str]) -> list[tuple[list[str], list[int]]]:
    """Distinct words of each text and how often it has them."""
    words = splitter.split([t.lower() for t in texts])
    _, which, place = words.distinct()
    edges = np.searchsorted(words.text, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(edges, edges[1:]):
        own, counts = np.unique(place[a:b], return_counts=True)
        out.append(([words.bytes_of(which[k]).decode() for k in own.tolist()], counts.tolist()))
    return out


def _as_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    splitter = Splitter(spaced=False)
    rows = ((label, t.as_py() or "") for b in batches for label, t in zip(b.column(0).to_pylist(), b.column(1)))
    for part in batched(rows, lambda x: len(x[1])):
        found = bags(splitter, [t for _, t in part])
        yield pa.record_batch({"label": pa.array([x for x, _ in part], pa.int32()), "words": pa.array([w for w, _ in found], pa.list_(pa.string())),
                               "counts": pa.array([c for _, c in found], pa.list_(pa.int32()))})


def train_on(df: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the rows of ``labels`` for whose id ``learn_from`` holds.

    At most TRAIN_ROWS of a label are learnt from, whole texts of theirs, chosen by a hash of
    the id; their weights bring back the shares of all those rows. Null labels, other labels
    than 0 and 1 and null ids take no part; an id that repeats in ``labels`` counts once, with
    its largest label. Without a labelled row the model says 0.05 for every text.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & learn_from).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    usable = materialise(usable, "labels")
    sizes = {r["_label"]: r["n"] for r in usable.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for label, most in enumerate(TRAIN_ROWS):
        own = usable.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(most)
        chosen = own if chosen is None else chosen.unionAll(own)
    # TRAIN_ROWS bounds what is broadcast, and what is collected.
    narrow = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    sample = narrow.join(F.broadcast(chosen), "_id").dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id")
    rows = sample.select("_label", "text").mapInArrow(_as_bags, "label int, words array<string>, counts array<int>").toArrow()
    truth = rows.column("label").to_numpy()
    words = rows.column("words").combine_chunks()
    coded = words.flatten().dictionary_encode()
    count = rows.column("counts").combine_chunks().flatten().to_numpy()
    doc = np.repeat(np.arange(len(truth)), words.value_lengths().to_numpy())
    held = Bags([w.encode() for w in coded.dictionary.to_pylist()], doc, coded.indices.to_numpy(), count, np.bincount(doc, weights=count, minlength=len(truth)))
    share = np.array([sizes.get(x, 0) for x in (0, 1)]) / np.maximum(1, np.bincount(truth, minlength=2))
    return train(held, truth, share[truth])


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, score``, the probability that the text is toxic.

    The whole text decides and nothing else. Null and empty texts, and texts without a word,
    get the score of no evidence. Null ids are kept, repeated rows are scored alike; an empty
    table gives no rows; other columns are not read.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(spaced=False)
        rows = ((i, t.as_py() or "") for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1)))
        for part in batched(rows, lambda x: len(x[1])):
            scores = held.value.score(splitter, [t for _, t in part])
            yield pa.record_batch({"doc_id": pa.array([i for i, _ in part], pa.int64()), "score": pa.array(scores, pa.float64())})

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, score double")


def keep_clean(df: DataFrame, model: Model, edge: float, text_col: str = "text") -> DataFrame:
    """Rows of ``df``, all columns, whose text scores less than ``edge``."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        splitter = Splitter(spaced=False)
        for texts in parts:
            out = [held.value.score(splitter, [t for t, in some]) for some in batched(((t or "",) for t in texts.tolist()), lambda x: len(x[0]))]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return df.where(score(F.col(text_col)) < edge)
