import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import topk


def brute(rows, k):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in sound:
        if q % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in sound if i != q and len(a) == len(b))
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("query_bytes, held", [(1 << 25, 1 << 20), (200, 10)])
def test_against_brute_force(spark, monkeypatch, query_bytes, held):
    monkeypatch.setattr(topk, "HELD_CANDIDATES", held)
    rng = random.Random(8)
    rows = [(i, [float(rng.choice([-1.5, 0.25, 0.5, rng.gauss(0, 1)])) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2050, [1.0] * 7 + [None]), (2100, [math.nan] * 8), (2150, [math.inf] * 8), (2200, [1.0, 2.0]), (2201, [0.5, 0.5]), (2250, []), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("v", F.lit(1))
    vectors = topk.integer_vectors(df.repartition(3), "vec_id", "embedding")
    found = topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5, query_bytes)
    assert {tuple(r) for r in found.collect()} == brute(rows, 5)


def test_large_components(spark):
    """Sums beyond doubles' whole numbers are exact, and one that is no long is an error, not a wrong rank."""
    rows = [(0, [2.0**25, 1.0]), (1, [2.0**20, 3.0]), (2, [2.0**20, 4.0]), (3, [-(2.0**20), 1e12]), (4, [1e200, -1e200]), (5, [-1e300, 1.0]), (6, [1e306, 0.0])]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    own = vectors.where("vec_id < 4")
    assert {tuple(r) for r in topk.top_k(own, own.where("vec_id % 50 = 0"), 2).collect()} == brute(rows[:4], 2)
    assert vectors.where("vec_id = 6").count() == 0
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(vectors, vectors.where("vec_id = 0"), 5).collect()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    for scale in (3, 200, 10**4, 10**9):
        exact = np.floor(rng.standard_normal((4000, 16)) * scale)
        cells, exponents = topk.cells_of(exact)
        scores = exact @ exact[7]
        own = topk._Candidates(np.array([7]), exact[7:8], 5)
        own.add(np.arange(4000), np.arange(4000), cells, exponents)
        held = own.take().to_pydict()
        assert all(u >= scores[r] for r, u in zip(held["row"], held["upper"], strict=True))
        scores[7] = -np.inf
        assert set(np.argsort(-scores)[:5].tolist()) <= set(held["row"]) and len(held["row"]) < 400


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, v array<double>")
    assert topk.top_k(df, df).count() == 0
