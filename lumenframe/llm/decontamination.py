"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items are looked for inside long documents. An item of n distinct
shingles that a document holds to a share of at least t misses at most
n - ceil(t n) of them there, so of any n - ceil(t n) + 1 of its shingles the
document holds one. The item's MinHash sketch is its that many smallest shingle
hashes, with n taken from the upper end of the item's size class; documents that
hit a sketch are candidates, whatever their length, and none is missed. Each
candidate is verified by exact containment on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import broadcast_if_small, only, word_array
from lumenframe.session import materialize, table

WIDTH = 5
CONTAINMENT_PERCENT = 80
#: Sketches of up to so many hashes are broadcast (16 bytes each); larger ones are joined by a shuffle.
BROADCAST_HASHES = 2_000_000


def _shingles(words: Column, width: int, of) -> Column:
    """of(words) for each run of `width` words; none if there are fewer."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: of([F.element_at(words, i + k) for k in range(width)]))


def _hashes(words: Column, width: int) -> Column:
    return _shingles(words, width, lambda own: F.xxhash64(*own))


def _texts(words: Column, width: int) -> Column:
    return F.array_distinct(_shingles(words, width, lambda own: F.concat_ws(" ", *own)))


def _words(df: DataFrame, *keys: str) -> DataFrame:
    """The words as a column of their own, so that they are split once for all shingles."""
    return df.select(*keys, word_array(F.col("text")).alias("w"))


def item_sketches(items: DataFrame, width: int, percent: int) -> DataFrame:
    """(item_id, hash): the smallest hashes of each item, as many as its size class needs."""
    worded = _words(items, "item_id").where(F.size("w") >= width)
    hashed = worded.select("item_id", F.array_sort(F.array_distinct(_hashes(F.col("w"), width))).alias("h"))
    size_class = F.floor(F.log2(F.size("h").cast("double"))).cast("int")
    upper = F.pow(F.lit(2.0), size_class + 1) - 1
    needed = upper - F.ceil(upper * percent / 100) + 1
    return hashed.select("item_id", F.explode(F.slice("h", 1, F.least(needed.cast("int"), F.size("h")))).alias("hash"))


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = CONTAINMENT_PERCENT) -> DataFrame:
    """Pairs of a document and an item whose shingles it holds to `percent` or more.

    Words are those of the lower-cased text between ASCII white space; shingles
    are runs of `width` words, counted once each. Columns: doc_id, item_id,
    item_shingles, shared, containment. Items with fewer than `width` words, or
    null ones, have no shingles and match nothing, and so do such documents.
    Rows that share a doc_id or an item_id are taken each by itself, and the
    pair gets the greatest containment. A null id matches nothing. Empty tables
    give no pairs. Other columns of docs and items are not looked at.
    """
    docs = only(docs, "doc_id", "text").where(F.col("doc_id").isNotNull())
    items = only(items, "item_id", "text").where(F.col("item_id").isNotNull())
    sketches = materialize(item_sketches(items, width, percent), "sketches")
    probe = sketches.dropDuplicates()
    if sketches.count() <= BROADCAST_HASHES:
        probe = F.broadcast(probe)
    shingled = _words(docs, "doc_id").select("doc_id", F.explode(_hashes(F.col("w"), width)).alias("hash"))
    candidates = materialize(shingled.join(probe, "hash").select("doc_id", "item_id").dropDuplicates(), "candidates")
    item_sets = _words(items, "item_id").where(F.size("w") >= width).select("item_id", _texts(F.col("w"), width).alias("item_set"))
    # A document's shingles are made once, whatever number of items it is a candidate for (at most all).
    asked = materialize(candidates.groupBy("doc_id").agg(F.collect_list("item_id").alias("items")), "asked")
    held = _words(docs.join(asked, "doc_id"), "doc_id", "items").select("doc_id", "items", _texts(F.col("w"), width).alias("doc_set"))
    held = held.select("doc_id", F.explode("items").alias("item_id"), "doc_set")
    shared = held.join(item_sets, "item_id").select("doc_id", "item_id", F.size("item_set").cast("long").alias("item_shingles"), F.size(F.array_intersect("doc_set", "item_set")).cast("long").alias("shared"))
    found = shared.where(F.col("shared") * 100 >= F.col("item_shingles") * percent)
    scored = found.withColumn("containment", F.col("shared") / F.col("item_shingles"))
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "item_shingles", "shared")).alias("best"))
    return best.select("doc_id", "item_id", "best.item_shingles", "best.shared", "best.containment")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = CONTAINMENT_PERCENT) -> DataFrame:
    """docs without the rows whose text holds an item; their columns stay as they are.

    A row is judged by its own text, whatever its doc_id, null or repeated: texts
    are told apart by 64-bit hashes. Null and empty texts stay; so does every row
    if items is empty.
    """
    own = "__text_" + "_".join(docs.columns)  # clashes with no column
    marked = docs.withColumn(own, F.xxhash64("text"))
    texts = marked.where(F.col("text").isNotNull()).select(F.col(own).alias("doc_id"), "text")
    found = materialize(contaminated(texts, items, width, percent).select(F.col("doc_id").alias(own)).dropDuplicates(), "leaked")
    return marked.join(broadcast_if_small(found), own, "left_anti").select(*[marked[c] for c in docs.columns])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM dw WHERE len(w) >= 5),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark),
its AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM iw WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS item_shingles FROM its GROUP BY item_id),
j AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN its USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment
FROM j JOIN n USING (item_id) WHERE shared * 100 >= item_shingles * 80
"""
