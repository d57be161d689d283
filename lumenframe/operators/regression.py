"""Linear regression by batch gradient descent, with ridge and contiguous folds, and a rule-based predictor."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import scores
from lumenframe.operators.ranks import with_rank


def grouped_moments(df: DataFrame, features: Sequence[str], target: str, by: Column) -> dict:
    """For each value of `by` (few) the matrix of sums of products of (1, features, target), in one pass.

    A gradient over all rows needs nothing else, so the descent itself runs on
    (features + 2) squared numbers, whatever the table's size.
    """
    columns = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")]
    places = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = [F.sum(columns[i] * columns[j]) for i, j in places]
    found = {}
    for row in df.dropna(subset=[*features, target]).groupBy(by.alias("__by")).agg(*[s.alias(f"m{k}") for k, s in enumerate(sums)]).collect():
        out = found[row["__by"]] = np.zeros((len(columns), len(columns)))
        for k, (i, j) in enumerate(places):
            out[i, j] = out[j, i] = float(row[f"m{k}"] or 0.0)
    return found


def moments(df: DataFrame, features: Sequence[str], target: str) -> np.ndarray:
    """grouped_moments of the whole table; zeros for an empty one."""
    size = len(features) + 2
    return grouped_moments(df, features, target, F.lit(0)).get(0, np.zeros((size, size)))


def descend(m: np.ndarray, rate: float, rounds: int, ridge: float) -> np.ndarray:
    """Weights (bias first) after `rounds` steps from 0; the bias is not regularised."""
    n, size = m[0, 0], len(m) - 1
    w = np.zeros(size)
    if n == 0:
        return w
    for _ in range(rounds):
        slope = (m[:size, :size] @ w - m[:size, size]) / n
        slope[1:] += ridge * w[1:]
        w -= rate * slope
    return w


def fit(df: DataFrame, features: Sequence[str], target: str, rate: float = 0.1, rounds: int = 500, ridge: float = 0.001) -> np.ndarray:
    return descend(moments(df, features, target), rate, rounds, ridge)


def predicted(df: DataFrame, features: Sequence[str], weights: np.ndarray, name: str = "predicted") -> DataFrame:
    total = F.lit(float(weights[0]))
    for f, w in zip(features, weights[1:], strict=True):
        total = total + F.col(f) * float(w)
    return df.withColumn(name, total)


def cross_validated(df: DataFrame, order: Sequence[str], features: Sequence[str], target: str, folds: int, rate: float = 0.1, rounds: int = 500, ridge: float = 0.001) -> list[float]:
    """Mean absolute error on each of `folds` contiguous parts of the order; the last takes the rest.

    The sums of a fold's training rows are those of all other folds, so one pass
    gives every model and a second one every error.
    """
    ranked = with_rank(df, order)
    size = F.greatest(F.floor(F.col("total_rows") / folds), F.lit(1))
    numbered = ranked.withColumn("__fold", F.least(F.floor(F.col("rank0") / size), F.lit(folds - 1)).cast("int"))
    own = grouped_moments(numbered, features, target, F.col("__fold"))
    empty = np.zeros((len(features) + 2, len(features) + 2))
    models = [descend(sum((m for k, m in own.items() if k != fold), empty), rate, rounds, ridge) for fold in range(folds)]
    weights = F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in models])
    mine = numbered.withColumn("__w", F.get(weights, F.col("__fold")))
    guess = sum((F.col(f) * F.get("__w", F.lit(i)) for i, f in enumerate(features, 1)), F.get("__w", F.lit(0)))
    errors = {r["__fold"]: r["mae"] for r in mine.groupBy("__fold").agg(F.avg(F.abs(guess - F.col(target))).alias("mae")).collect()}
    return [float(errors.get(k) or 0.0) for k in range(folds)]


#: Base CRF, base kbps and the range of kbps of each resolution category; fixed values.
RATE_TABLE = {"Low": (28.0, 500, 200, 800), "Sd480P": (26.0, 1500, 500, 2000), "Hd720P": (24.0, 3000, 1500, 5000), "Fhd1080P": (23.0, 5000, 3000, 10_000), "Uhd4K": (22.0, 15_000, 10_000, 40_000)}
#: Efficiency of codecs against the first generation, 1 for others; fixed values.
CODEC_FACTORS = {"av1": 1.4, "hevc": 1.3, "h265": 1.3, "vp9": 1.25, "vp8": 0.9, "mpeg2": 0.6}


def with_encoding_prediction(df: DataFrame, width: Column, height: Column, rate: Column, codec: Column, target: Column, complexity: Column) -> DataFrame:
    """The rows with a rule-based crf, kbps, min_kbps, max_kbps and vmaf.

    The CRF moves from the category's base with complexity (2 either way) and with
    the target score (half a step a point from 93); kbps double every 6 steps of it.
    Codecs are compared without case; a null one counts as any other. Steps are
    columns of their own, so that no expression is repeated inside the next.
    """
    rows = F.create_map(*[x for name, row in RATE_TABLE.items() for x in (F.lit(name), F.struct(*[F.lit(v).alias(n) for n, v in zip(("crf", "kbps", "low", "high"), row, strict=True)]))])
    factors = F.create_map(*[F.lit(x) for pair in CODEC_FACTORS.items() for x in pair])
    within = lambda c, low, high: F.least(F.greatest(c, low), high)
    inputs = {"__size": width.cast("long") * height * rate, "__factor": F.coalesce(F.try_element_at(factors, F.lower(codec)), F.lit(1.0)), "__complexity": complexity, "__base": F.element_at(rows, scores.resolution_category(width, height))}
    own = df.withColumns(inputs | {"__target": target})
    own = own.withColumn("crf", within(F.col("__base.crf") - (F.col("__complexity") - 0.5) * 4 - (F.col("__target") - 93) * 0.5, F.lit(15.0), F.lit(35.0)))
    own = own.withColumn("__kbps", F.greatest((F.col("__base.kbps") * F.pow(F.lit(2.0), (F.col("__base.crf") - F.col("crf")) / 6) * (1 / F.col("__factor"))).cast("long"), F.lit(100)))
    held = lambda share: within((F.col("__kbps") * share).cast("long"), F.col("__base.low").cast("long"), F.col("__base.high").cast("long"))
    vmaf = within(70 + F.least(F.col("__kbps") * 1000.0 / F.col("__size") * 500, F.lit(25.0)) - F.col("__complexity") * 5, F.lit(40.0), F.lit(100.0))
    made = own.withColumns({"kbps": held(1.0), "min_kbps": held(0.6), "max_kbps": held(1.5), "vmaf": vmaf})
    return made.drop("__size", "__factor", "__complexity", "__base", "__target", "__kbps")
