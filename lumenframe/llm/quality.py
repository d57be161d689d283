"""Quality by nearest-neighbour voting in a latent semantic space.

Labelled documents become vectors: character n-grams weighted by inverse
document frequency and terms for repetition and letter case, brought to a few
latent dimensions by the leading singular vectors. They are broadcast; the exact
cosines of every document with all of them are computed in blocks, and the
nearest vote with weights that grow with similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm.common import Shared
from lumenframe.llm.labelled import labelled_features, scorer_of, usable_labels, with_scores
from lumenframe.session import table

#: At most so many documents of each label are learnt from and vote.
PER_CLASS = 2000
#: Bytes in an n-gram; 2**BITS hashed terms.
SIZES = (1, 2)
BITS = 11
DIMENSIONS = 64
NEIGHBOURS = 15
#: A neighbour's vote is its cosine to this power.
POWER = 8
THRESHOLD = 0.5
MODULUS, HELD_OUT = 3, 1
#: Documents in a block of cosines: BLOCK x 2 PER_CLASS floats.
BLOCK = 256
#: Steps into which a share from 0 to 1 is spread as terms.
STEPS = 10


def _counts(raw: np.ndarray) -> np.ndarray:
    data, total = raw.astype(np.uint32), np.zeros(1 << BITS, np.float32)
    h = np.zeros(len(data), np.uint32)
    for n in range(1, max(SIZES) + 1):
        if len(data) < n:
            break
        h = h[: len(data) - n + 1] * np.uint32(773) + data[n - 1 :] + np.uint32(1)
        if n in SIZES:
            total += np.bincount(((h ^ np.uint32(n * 77_777)) * np.uint32(2_654_435_761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return total


def _shares(text: str) -> list[float]:
    words = text.split()
    lines = [line for line in text.split("\n") if line]
    n = max(len(words), 1)
    return [
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(words)) / n,
        1 - len(set(zip(words, words[1:], strict=False))) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(word.isupper() for word in words) / n,
        min(1.0, np.log1p(len(text)) / 12),
        sum(map(len, words)) / n / 20,
    ]


def terms(text: str) -> np.ndarray:
    """Counts of hashed n-grams, then the shares spread over their steps."""
    shares = np.clip(_shares(text), 0, 1) * STEPS
    spread = np.zeros((len(shares), STEPS + 1), np.float32)
    low = np.minimum(shares.astype(int), STEPS - 1)
    rows = np.arange(len(shares))
    spread[rows, low] = 1 - (shares - low)
    spread[rows, low + 1] = shares - low
    return np.concatenate([_counts(np.frombuffer(f" {text} ".encode(), np.uint8)), spread.ravel()])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    y: np.ndarray
    base: float

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        size = 1 << BITS
        grams = _unit(np.log1p(counts[:, :size]) * self.idf)
        spread = counts[:, size:]
        return np.concatenate([grams, spread / np.sqrt(max(1, spread.shape[1] // (STEPS + 1)))], axis=1).astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.y):
            return np.full(len(texts), self.base)
        latent = _unit(self.weighted(np.stack([terms(t) for t in texts])) @ self.axes)
        cosines = latent @ self.vectors.T
        k = min(NEIGHBOURS, len(self.y))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** POWER
        total = votes.sum(axis=1)
        return np.where(total > 0, np.clip((votes * self.y[near]).sum(axis=1) / np.maximum(total, 1e-300), 0, 1), self.base)


def fit_model(counts: np.ndarray, y: np.ndarray, totals: dict[int, int]) -> Model:
    base = (totals.get(1, 0) + 1) / (totals.get(0, 0) + totals.get(1, 0) + 2)
    held = (counts[:, : 1 << BITS] > 0).sum(axis=0) if len(counts) else np.zeros(1 << BITS)
    model = Model((np.log((1 + len(counts)) / (1 + held)) + 1).astype(np.float32), np.empty((0, 0), np.float32), np.empty((0, 0), np.float32), y, base)
    if len(y):
        weighted = model.weighted(counts)
        _, axes = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
        model.axes = np.ascontiguousarray(axes[:, ::-1][:, :DIMENSIONS], np.float32)
        model.vectors = _unit(weighted @ model.axes)
    return model


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", per_class: int = PER_CLASS, modulus: int = MODULUS, held_out: int = HELD_OUT) -> Model:
    usable = usable_labels(labels, column, modulus, held_out)
    raw, y, totals = labelled_features(docs, usable, per_class, lambda text: terms(text).astype(np.float32).tobytes())
    counts = np.stack([np.frombuffer(r, np.float32) for r in raw]) if raw else np.empty((0, 0), np.float32)
    return fit_model(counts, y, totals)


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; the whole text counts.

    Null and empty texts are texts without words. Repeated rows get a row each;
    without labels, or with no neighbour of positive cosine, the score is the
    smoothed base rate; empty tables give no rows; other columns are not used.
    """
    shared = Shared(docs.sparkSession, "quality", model)
    return with_scores(docs, scorer_of(lambda texts: shared.value.scores(texts), BLOCK), MODULUS, HELD_OUT, threshold)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
