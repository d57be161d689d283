"""Bounded labelled samples, on which the classifiers are fitted."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import only, rest_crc32


def usable_labels(labels: DataFrame, column: str, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from, one a document.

    Left out: rows whose crc32(doc_id as text) mod modulus is held_out, null ids
    and labels that are neither 0 nor 1. Where rows of a document differ, 1 holds.
    """
    own = only(labels, "doc_id", column).where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    own = own.where(rest_crc32(F.col("doc_id"), modulus) != held_out)
    return own.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))


def labelled_features(docs: DataFrame, usable: DataFrame, per_class: int, feature: Callable[[str], bytes]) -> tuple[list[bytes], np.ndarray, dict[int, int]]:
    """(features, labels, documents by label) of at most per_class documents of each label.

    The documents of the smallest hashes of doc_id are taken, so the sample is
    the same however the tables are split. `feature` turns a text into bytes on
    the executors. All usable labels count in the third result.
    """
    totals = {row["label"]: row["count"] for row in usable.groupBy("label").count().collect()}
    picked = [usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for label in (0, 1)]
    sample = F.broadcast(picked[0].unionAll(picked[1]))

    def features(batches):
        for batch in batches:
            texts = batch.column(2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([feature(t.as_py() or "") for t in texts], pa.binary())], ["doc_id", "label", "feature"])

    rows = only(docs, "doc_id", "text").join(sample, "doc_id").select("doc_id", "label", "text").mapInArrow(features, "doc_id long, label int, feature binary")
    one_each = rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("feature").alias("feature"))
    found = one_each.toArrow()  # at most 2 * per_class rows, as many as the sample
    order = np.argsort(found.column("doc_id").to_numpy())
    labels, raw = found.column("label").to_numpy()[order].astype(np.float64), found.column("feature").to_pylist()
    del found
    pa.default_memory_pool().release_unused()
    return [raw[at] for at in order], labels, totals


def with_scores(docs: DataFrame, scorer, modulus: int, held_out: int, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; scorer maps Arrow batches."""
    scored = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(scorer, "doc_id long, score double")
    return scored.select("doc_id", (rest_crc32(F.col("doc_id"), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scorer_of(score: Callable[[list[str]], np.ndarray], rows: int):
    """An Arrow mapper that scores `rows` texts at a time; null texts are empty ones."""

    def scorer(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            scores = [score([t.as_py() or "" for t in texts[at : at + rows]]) for at in range(0, len(texts), rows)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "score"])

    return scorer
