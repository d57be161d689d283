"""What several of the operators share."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space, tab, line feed, vertical tab, form feed, return.
BLANKS = r"[\x20\x09-\x0D]+"

#: A-Z only, so that letters outside ASCII stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    return sys.__dict__.setdefault("_lumenframe_cache", {})


def small_batches(batches, rows: int = 512):
    """Arrow batches cut into ones of at most `rows` rows: what a function makes of one stands in memory at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Shared:
    """A broadcast value of any class; executors need no module of ours to read it.

    A worker keeps one value a name, across its tasks.
    """

    def __init__(self, spark: SparkSession, name: str, value):
        self.name, self.token = name, uuid.uuid4().hex
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        slots = worker_cache().setdefault("shared", {})
        if slots.get(self.name, ("",))[0] != self.token:
            slots[self.name] = (self.token, cloudpickle.loads(self.data.value))
        return slots[self.name][1]


def rest_crc32(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def word_array(text: Column) -> Column:
    """Words of the lower-cased text as an array, natively; null: no words."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANKS), "")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns can't clash."""
    return df.select(*[df[c] for c in columns])


#: Up to so many ids are broadcast (some 16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def broadcast_if_small(ids: DataFrame) -> DataFrame:
    """A written table of ids, broadcast if it holds at most BROADCAST_IDS."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def collect_bounded(df: DataFrame, bound: int) -> list:
    """At most `bound` rows on the driver; more is an error, never a cut."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} rows where the bound is {bound}")
    return rows
