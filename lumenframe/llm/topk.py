"""Exact top-k search by vector-approximation files.

Two files stand in the shared folder: the exact vectors, and their quantised
cells, a byte a component. The cells of all vectors are scanned for bounds of
the score, and only vectors whose upper bound reaches the k-th best lower bound
are kept as candidates. Their exact vectors are read in the order of the bounds:
first the k best bounds of each query, then those whose bound the k-th exact
score doesn't rule out; then the result is certain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.llm.common import Shared, only
from lumenframe.session import materialize, table

#: What a pass over the cells broadcasts: the queries of a block, 8 bytes a component.
QUERY_BYTES = 1 << 25
#: Vectors scanned at once in a task, and queries whose bounds stand in memory at once.
SCAN_BLOCK, BOUND_QUERIES = 8192, 256
#: Candidates a task holds before it writes them out.
HELD_CANDIDATES = 1 << 20
#: Cells are bytes: vectors whose components are below 2**CELL_BITS have cells of width 1.
CELL_BITS = 7


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): v = floor(scale * x) of each component, x as double; whole numbers in doubles.

    Vectors that are null, or hold a null, NaN or infinite component (or one
    that is infinite once scaled), are left out, and so are rows of a null id.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double") * F.lit(float(scale)))
    sound = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = lambda c: F.when(F.abs(c) < F.lit(2.0**53), F.floor(c).cast("double")).otherwise(c)
    rows = only(df, id_col, vector_col).where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v")).where(sound).select("vec_id", F.transform("v", whole).alias("v"))


def _matrix(column: pa.ListArray, rows: np.ndarray, size: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)


def cells_of(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells as int8, width exponent of each vector): a cell c holds c 2**e to (c + 1) 2**e - 1."""
    greatest = np.abs(exact).max(axis=1, initial=0.0)
    exponent = np.maximum(np.frexp(greatest)[1] - CELL_BITS, 0)
    return np.floor(np.ldexp(exact, -exponent[:, None])).astype(np.int8), exponent.astype(np.int32)


def _quantise(batches):
    for batch in batches:
        vectors = batch.column(1)
        sizes, cells = vectors.value_lengths().to_numpy(), np.empty(batch.num_rows, object)
        exponents = np.zeros(batch.num_rows, np.int32)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            own, exponents[rows] = cells_of(_matrix(vectors, rows, size))
            cells[rows] = [c.tobytes() for c in own]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(exponents), pa.array(cells, pa.binary())], ["vec_id", "row", "exponent", "cells"])


def _centres(cells: np.ndarray, exponents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, half width, greatest size of a component) of each vector's cells."""
    half = (np.ldexp(1.0, exponents) - 1) / 2
    centre = np.ldexp(cells.astype(np.float64), exponents[:, None]) + half[:, None]
    return centre, half, np.abs(centre).max(axis=1, initial=0.0) + half


class _Candidates:
    """The vectors of a task that may be among the k best of a query."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        with np.errstate(over="ignore"):
            self.ids, self.q, self.k = ids, q.astype(np.float32), k
        self.sums = np.abs(q).sum(axis=1)
        self.lower = np.full((len(ids), k), -np.inf, np.float32)  # the k best lower bounds, the least first
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, ids: np.ndarray, rows: np.ndarray, cells: np.ndarray, exponents: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            self._add(ids, rows, *_centres(cells, exponents))

    def _add(self, ids: np.ndarray, rows: np.ndarray, centre: np.ndarray, half: np.ndarray, greatest: np.ndarray) -> None:
        centre = centre.astype(np.float32)
        # |q.x - q.centre| <= sum |q| half; the rest covers the rounding of floats.
        error = half + greatest * (centre.shape[1] + 16) * 2.0**-22
        order = np.argsort(ids, kind="stable")
        for at in range(0, len(self.ids), BOUND_QUERIES):
            own = slice(at, at + BOUND_QUERIES)
            middle = self.q[own] @ centre.T
            margin = np.outer(self.sums[own], error).astype(np.float32)
            upper, lower = middle + margin, middle - margin
            lost = ~(np.isfinite(upper) & np.isfinite(lower))  # too large for floats: never ruled out
            upper[lost], lower[lost] = np.inf, -np.inf
            first, last = (np.searchsorted(ids, self.ids[own], side, sorter=order) for side in ("left", "right"))
            for query in np.flatnonzero(last > first):
                same = order[first[query] : last[query]]
                upper[query, same] = lower[query, same] = -np.inf
            better = np.flatnonzero((lower > self.lower[own, :1]).any(axis=1))
            if len(better):
                both = np.concatenate([self.lower[own][better], lower[better]], axis=1)
                self.lower[at + better] = np.sort(np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :], axis=1)
            query, which = np.nonzero((upper >= self.lower[own, :1]) & (upper > -np.inf))
            self.parts.append(((at + query).astype(np.int32), rows[which], upper[query, which]))
            self.held += len(query)

    def take(self) -> pa.RecordBatch:
        """The candidates held, less those that the bounds since found rule out; they are held no longer."""
        query, row, upper = (np.concatenate([p[k] for p in self.parts]) if self.parts else np.empty(0, t) for k, t in ((0, np.int32), (1, np.int64), (2, np.float32)))
        left = upper >= self.lower[query, 0] if len(query) else np.empty(0, bool)
        self.parts, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(self.ids[query[left]], pa.int64()), pa.array(row[left], pa.int64()), pa.array(upper[left].astype(np.float64))], ["query_id", "row", "upper"])


def _scanner(shared, k: int):
    def scan(batches):
        found = {size: _Candidates(ids, q, k) for size, (ids, q) in shared.value.items()}
        for batch in batches:
            ids, rows, exponents, cells = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            sizes = np.array([len(c) for c in cells.to_pylist()])
            for size, own in found.items():
                held = np.flatnonzero(sizes == size)
                for at in range(0, len(held), SCAN_BLOCK):
                    part = held[at : at + SCAN_BLOCK]
                    raw = np.frombuffer(b"".join(cells.take(pa.array(part)).to_pylist()), np.int8).reshape(len(part), size)
                    own.add(ids[part], rows[part], raw, exponents[part])
                    if own.held > HELD_CANDIDATES:
                        yield own.take()
        for own in found.values():
            yield own.take()

    return scan


def _exact_scores(batches):
    """Exact inner products; whole numbers beyond 2**62 in Python's, and an error if a score is no long."""
    for batch in batches:
        q, v = batch.column(3), batch.column(4)
        sizes, scores = v.value_lengths().to_numpy(), np.zeros(batch.num_rows, np.int64)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            a, b = _matrix(q, rows, size), _matrix(v, rows, size)
            bound = np.abs(a).max(axis=1, initial=0.0) * np.abs(b).max(axis=1, initial=0.0) * size
            small = bound < 2.0**62
            scores[rows[small]] = (a[small].astype(np.int64) * b[small].astype(np.int64)).sum(axis=1)
            for k in np.flatnonzero(~small):
                score = sum(int(x) * int(y) for x, y in zip(a[k], b[k], strict=True))
                if not -(2**63) <= score < 2**63:
                    raise OverflowError(f"the inner product {score} is beyond 64 bits; scale the vectors down")
                scores[rows[k]] = score
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(scores)], ["query_id", "row", "vec_id", "score"])


def _scored(candidates: DataFrame, asked: DataFrame, exact: DataFrame) -> DataFrame:
    queries = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    both = candidates.select("query_id", "row").join(queries, "query_id").join(exact, "row")
    return both.select("query_id", "row", "vec_id", "q", "v").mapInArrow(_exact_scores, "query_id long, row long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k vectors of greatest inner product for each query, but for its own id.

    vectors, queries: (vec_id long, v array<double>), as of integer_vectors().
    Queries pass over the cells in blocks of about query_bytes; a task holds the
    k best lower bounds of each query of the block and its candidates. Ties go to
    the smaller vec_id; vectors of another length than the query's don't compete;
    with fewer than k candidates all are returned; of repeated ids each row
    competes, but no row of the query's own id, and the row of the least vector
    asks; without vectors or queries the result is empty. A score read that is
    beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    exact = materialize(vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("row")), "topk-exact")
    cells = materialize(exact.select("vec_id", "v", "row").mapInArrow(_quantise, "vec_id long, row long, exponent int, cells binary"), "topk-cells")
    asked = materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    whole = asked.agg(F.sum(8 * F.size("v").cast("long") + 8).alias("bytes")).first()["bytes"] or 0
    blocks, candidates = max(1, -(-whole // query_bytes)), []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        ids, v = own.column("vec_id").to_numpy(), own.column("v").combine_chunks()
        sizes = v.value_lengths().to_numpy() if len(v) else np.empty(0, np.int64)
        by_size = {int(n): (ids[sizes == n], _matrix(v, np.flatnonzero(sizes == n), n)) for n in np.unique(sizes)}
        shared = Shared(spark, "topk-queries", by_size)
        candidates.append(materialize(cells.mapInArrow(_scanner(shared, k), "query_id long, row long, upper double"), "topk-candidates"))
        shared.data.unpersist()
    merged = candidates[0]
    for part in candidates[1:]:
        merged = merged.unionAll(part)
    by_bound = W.partitionBy("query_id").orderBy(F.col("upper").desc(), "row")
    first = merged.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= k)
    read = materialize(_scored(first, asked, exact), "topk-first")
    # The k-th exact score so far; with fewer than k there are no more candidates.
    least = read.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
    rest = merged.join(least, "query_id").where(F.col("upper") >= F.col("least")).join(read.select("query_id", "row"), ["query_id", "row"], "left_anti")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = read.unionByName(_scored(rest, asked, exact)).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP5_SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
