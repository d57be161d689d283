"""Toxicity: a character n-gram linear classifier with naive Bayes features.

Each n-gram that a text holds is a feature whose value is the n-gram's naive
Bayes log-count ratio between the classes, 0 where too few texts hold it; a
text's features are scaled by their length and a logistic regression is fitted
on them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm.common import Shared, small_batches
from lumenframe.llm.labelled import labelled_features, scorer_of, usable_labels, with_scores
from lumenframe.session import table

#: At most so many documents of each label are learnt from; each sends the driver at most 2**BITS / 8 bytes, so all less than 100 MB.
PER_CLASS = 1500
#: Bytes in an n-gram of the lower-cased text with a blank at either end.
SIZES = (3, 4, 5)
#: n-grams are hashed into 2**BITS features.
BITS = 18
ROUNDS, STEP, DECAY = 50, 1.0, 1e-5
#: A ratio counts if so many sampled texts hold its n-gram.
LEAST_TEXTS = 4
THRESHOLD = 0.3
MODULUS, HELD_OUT = 4, 2
#: Bytes hashed at once.
CHUNK = 1 << 22
#: Sampled texts whose features are taken at once in a round.
FIT_TEXTS = 128


def ngrams(text: str) -> np.ndarray:
    """The distinct hashed n-grams of a text, ascending."""
    raw = np.frombuffer(b" " + text.encode().lower() + b" ", np.uint8)
    found = [_ngrams(raw[max(0, at - max(SIZES) + 1) : at + CHUNK]) for at in range(0, len(raw), CHUNK)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _ngrams(raw: np.ndarray) -> np.ndarray:
    data, found = raw.astype(np.uint32), []
    h = np.zeros(len(data), np.uint32)
    for n in range(1, max(SIZES) + 1):
        if len(data) < n:
            break
        h = h[: len(data) - n + 1] * np.uint32(773) + data[n - 1 :] + np.uint32(1)
        if n in SIZES:
            found.append(((h ^ np.uint32(n * 77_777)) * np.uint32(2_654_435_761)) >> np.uint32(32 - BITS))
    if not found:
        return np.empty(0, np.uint32)
    own = np.sort(np.concatenate(found))
    return own[np.concatenate([[True], own[1:] != own[:-1]])]


def packed(features: np.ndarray) -> bytes:
    """A text's features as they travel to the driver: at most 2**BITS / 8 bytes, a bit each where that is less."""
    if 4 * len(features) < 1 << BITS - 3:
        return b"n" + features.tobytes()
    held = np.zeros(1 << BITS, bool)
    held[features] = True
    return b"b" + np.packbits(held).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if raw[:1] == b"n":
        return np.frombuffer(raw, np.uint32, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=1))).astype(np.uint32)


@dataclass
class Model:
    """weighted: weight x ratio of each feature; squared: ratio squared; bias: log odds of an empty text."""

    weighted: np.ndarray
    squared: np.ndarray
    bias: float

    def log_odds(self, features: np.ndarray) -> float:
        return self.bias + float(self.weighted[features].sum()) / np.sqrt(1 + float(self.squared[features].sum()))

    def scores(self, texts: list[str]) -> np.ndarray:
        odds = np.array([self.log_odds(ngrams(text)) for text in texts])
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _block(features: list[np.ndarray], column: np.ndarray, times: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, row, value) of some texts, each text scaled by its length; a column stands for `times` features."""
    kept = [np.unique(own[own >= 0]) for own in (column[f] for f in features)]
    at = np.concatenate(kept)
    row = np.repeat(np.arange(len(kept)), [len(own) for own in kept])
    value = ratio[at]
    return at.astype(np.int32), row.astype(np.int32), (value / np.sqrt(1 + np.bincount(row, weights=times[at] * value * value, minlength=len(kept)))[row]).astype(np.float32)


def fit_model(features: list[np.ndarray], y: np.ndarray, totals: dict[int, int]) -> Model:
    """Fits on a sample; totals: documents of each label, whose odds the bias is set to."""
    size = 1 << BITS
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    prior = np.log((totals.get(1, 0) + 1) / (totals.get(0, 0) + 1))
    if not n1 or not n0:
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), float(prior))
    held = np.full((2, size), 0.5)
    texts, mark = np.zeros(size, np.uint64), np.random.default_rng(0).integers(0, 1 << 64, len(y), np.uint64)
    for text, (own, label) in enumerate(zip(features, y.astype(int).tolist(), strict=True)):
        held[label, own] += 1  # a text's n-grams are distinct
        texts[own] += mark[text]
    ratio = np.log((held[1] / (n1 + 1)) / (held[0] / (n0 + 1)))
    ratio[held[0] + held[1] < LEAST_TEXTS + 1] = 0
    ratio = ratio.astype(np.float32)
    # Features that the same texts hold have the same weight all along: one column, taken several times.
    counted = np.flatnonzero(ratio)
    _, first, own, times = np.unique(texts[counted], return_index=True, return_inverse=True, return_counts=True)
    column = np.full(size, -1, np.int64)
    column[counted] = own
    blocks = [_block(features[at : at + FIT_TEXTS], column, times, ratio[counted[first]]) for at in range(0, len(y), FIT_TEXTS)]
    weight, bias = np.zeros(len(first), np.float32), 0.0
    seen = np.full(len(first), 1e-8, np.float32)
    for _ in range(ROUNDS):
        slope, errors, several = np.zeros(len(first)), 0.0, weight * times
        for block, (at, row, value) in enumerate(blocks):
            label = y[block * FIT_TEXTS : (block + 1) * FIT_TEXTS]
            odds = np.bincount(row, weights=several[at] * value, minlength=len(label)) + bias
            error = (1 / (1 + np.exp(-odds)) - label).astype(np.float32)
            slope += np.bincount(at, weights=value * error[row], minlength=len(first))
            errors += float(error.sum())
        slope = (slope / len(y)).astype(np.float32) + DECAY * weight
        seen += slope * slope
        weight -= STEP * slope / np.sqrt(seen)
        bias -= 0.5 * errors / len(y)
    weighted = np.zeros(size)
    weighted[counted] = weight[own] * ratio[counted]
    return Model(weighted.astype(np.float32), ratio * ratio, float(bias + prior - np.log(n1 / n0)))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", per_class: int = PER_CLASS, modulus: int = MODULUS, held_out: int = HELD_OUT) -> Model:
    usable = usable_labels(labels, column, modulus, held_out)
    raw, y, totals = labelled_features(docs, usable, per_class, lambda text: packed(ngrams(text)))
    raw.reverse()
    return fit_model([unpacked(raw.pop()) for _ in range(len(raw))], y, totals)  # a text's bytes go as its features come


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; the whole text counts.

    Null and empty texts have no features and get the labels' base rate.
    Repeated rows get a row each; with no label of either kind the score is the
    smoothed base rate; empty tables give no rows; other columns are not used.
    """
    shared = Shared(docs.sparkSession, "toxicity", model)
    return with_scores(docs, scorer_of(lambda texts: shared.value.scores(texts), 256), MODULUS, HELD_OUT, threshold)


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores `threshold` or more; their columns stay as they are.

    A model that found no n-gram to tell by (no labels, or of one kind alone)
    rejects nothing, whatever the base rate.
    """
    if not model.squared.any():
        return docs
    shared = Shared(docs.sparkSession, "toxicity", model)
    schema, at = docs.schema, docs.columns.index("text")

    def keep(batches):
        for batch in small_batches(batches):
            texts = [t.as_py() or "" for t in batch.column(at)]
            yield batch.filter(pa.array(shared.value.scores(texts) < threshold, pa.bool_()))

    return docs.mapInArrow(keep, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
