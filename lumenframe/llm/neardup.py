"""MinHash near-deduplication by a multi-index Hamming join.

A document's signature has CHUNKS x CHUNK symbols of 10 bits, each the low bits
of the least of its shingles' hashes under one function. Two signatures whose
distance (symbols that differ) is at most CHUNKS x (ERRORS + 1) - 1 = 31 agree,
by pigeonhole, but for ERRORS = 1 symbol on one chunk at least. Every chunk is
therefore indexed under each of its CHUNK keys with one symbol left out, and all
pairs under that distance share a key. Pairs that share a key, and whose parity
sketches don't rule a link out, are confirmed on the full shingle sets. The
distance of a pair of similarity 0.8 varies about 19.2; the chance that such a
pair shares no key is (1 - 0.8^6 - 6 x 0.2 x 0.8^5)^16, one in 25 million.

Not all pairs of a key are made. Equal sets are one node. The members of a key
are first compared with its smallest; only members that are then not connected
with each other are compared pairwise, so no link between different texts that
would connect anything is lost, and groups of many near copies cost a row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import broadcast_if_small, only, small_batches
from lumenframe.llm.components import connected_components
from lumenframe.session import materialize, table

CHUNKS, CHUNK = 16, 6
#: Bits of a symbol; CHUNK of them and the number of a key fit a long.
SYMBOL = 10
PERCENT = 80
#: Shingles hashed at once.
BLOCK = 4096

_SEEDS = np.random.default_rng(20_240_229)
MULTIPLIERS = _SEEDS.integers(0, 1 << 31, CHUNKS * CHUNK, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADDENDS = _SEEDS.integers(0, 1 << 32, CHUNKS * CHUNK, dtype=np.uint32)
SIGNATURE = [f"s{c}" for c in range(CHUNKS)]
#: A set's parity sketch has 64 bits in each of these: the parity of its shingles that hash there.
PARITY = [f"o{c}" for c in range(16)]


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of `width` words.

    Words: runs of anything but ASCII white space, A-Z lower-cased. Fewer words
    than `width` are one shingle; none, or a null text, give the empty set.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(words))
    mixed = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : len(words) - k + 1 + i]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """CHUNKS longs of CHUNK symbols of SYMBOL bits; the set must not be empty."""
    low = shingles.astype(np.uint32)
    least = np.full(CHUNKS * CHUNK, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), BLOCK):
        hashed = np.multiply.outer(low[at : at + BLOCK], MULTIPLIERS)
        hashed += ADDENDS
        np.minimum(least, hashed.min(axis=0), out=least)
    symbols = (least >> np.uint32(3) & np.uint32((1 << SYMBOL) - 1)).astype(np.int64).reshape(CHUNKS, CHUNK)
    return (symbols << SYMBOL * np.arange(CHUNK)).sum(axis=1)


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bits by which the sketches of two sets differ are no more than the shingles by which the sets do."""
    bits = 64 * len(PARITY)
    held = np.bincount((shingles * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
    return np.packbits(held.astype(np.uint8)).view("<i8")


def _signatures(width: int):
    def signatures(batches):
        import xxhash

        for batch in small_batches(batches):
            sizes, digests, rows = [], [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py(), width)
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                rows.append(np.concatenate([signature(own) if len(own) else np.zeros(CHUNKS, np.int64), parity_sketch(own)]))
            columns = np.stack(rows).T if rows else np.empty((CHUNKS + len(PARITY), 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *[pa.array(c) for c in columns]], ["doc_id", "n", "digest", *SIGNATURE, *PARITY])

    return signatures


def _sets(width: int):
    def sets(batches):
        for batch in small_batches(batches):
            found = [shingle_set(text.as_py(), width).view(np.int64) for text in batch.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "shingles"])

    return sets


def signatures_of(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, digest of the set, signature), without the texts."""
    schema = "doc_id long, n long, digest binary, " + ", ".join(f"{s} long" for s in SIGNATURE + PARITY)
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(_signatures(width), schema)


def _keys() -> Column:
    """The keys of a signature: each chunk without one symbol, whose place holds chunk and place."""
    keys = []
    for c, name in enumerate(SIGNATURE):
        for p in range(CHUNK):
            hole = (1 << SYMBOL) - 1 << SYMBOL * p
            keys.append(F.col(name).bitwiseAND(F.lit(~hole)).bitwiseOR(F.lit(c * CHUNK + p << SYMBOL * p)))
    return F.array(*keys)


def _near(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.select(F.col("node").alias(prefix), F.col("n").alias(f"{prefix}_n"), *[F.col(s).alias(f"{prefix}_{s}") for s in PARITY])


def _may_link() -> Column:
    """False only for pairs that can't link.

    Sets of a and b shingles that link differ by at most
    (a + b) (100 - PERCENT) / (100 + PERCENT) of them, and so do their sketches.
    """
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    differ = F.lit(0)
    for name in PARITY:
        differ = differ + F.bit_count(F.col(f"a_{name}").bitwiseXOR(F.col(f"b_{name}")))
    may_differ = differ * (100 + PERCENT) <= (F.col("a_n") + F.col("b_n")) * (100 - PERCENT)
    return (small * 100 >= large * PERCENT) & may_differ


def confirmed(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets have 100 x shared >= PERCENT x united."""
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).dropDuplicates(), "confirm-ids")
    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").join(broadcast_if_small(ids), "doc_id", "left_semi")
    sets = materialize(texts.mapInArrow(_sets(width), "doc_id long, shingles array<long>"), "sets")
    # The set of b first: a is the hub of many pairs, and its set must not be shuffled once a pair.
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("b_set")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("a_set")), "a")
    counted = both.select("a", "b", (F.size("a_set") + F.size("b_set")).alias("sum"), F.size(F.array_intersect("a_set", "b_set")).alias("shared"))
    return counted.where((F.col("shared") > 0) & (F.col("shared") * 100 >= (F.col("sum") - F.col("shared")) * PERCENT)).select("a", "b")


def near_duplicates(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    component_id: the smallest doc_id that links reach; kept: it is the row's
    own. Documents link if the Jaccard similarity of their sets of `width`-word
    shingles is at least PERCENT / 100. Texts without words, empty or null, link
    with nothing. Rows that share a doc_id are one node with the links of all,
    each a row of the result. Rows of a null doc_id get a null component and are
    kept. An empty table gives no rows. Other columns are not used.
    """
    signed = materialize(signatures_of(docs, width), "signatures")
    linked = signed.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # Equal sets: one node, the smallest id, and a link from each copy.
    grouped = linked.groupBy("digest").agg(F.min(F.struct("doc_id", "n", *SIGNATURE, *PARITY)).alias("first"), F.count("*").alias("copies"))
    grouped = materialize(grouped.select("digest", "copies", F.col("first.doc_id").alias("node"), "first.n", *[f"first.{s}" for s in SIGNATURE + PARITY]), "nodes")
    nodes = grouped.drop("digest", "copies")
    several = grouped.where(F.col("copies") > 1).select("digest", "node")
    copies = linked.select("doc_id", "digest").join(several, "digest").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).where(F.col("a") != F.col("b"))
    # The index, and from it each key's members against the key's smallest.
    index = nodes.select("node", F.explode(_keys()).alias("key"))
    shared = materialize(index.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).where(F.col("members") > 1).select("key", "pivot"), "keys")
    members = materialize(index.join(shared, "key"), "members")
    stars = members.where(F.col("node") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("node").alias("b")).dropDuplicates()
    stars = materialize(stars.join(_near(nodes, "a"), "a").join(_near(nodes, "b"), "b").where(_may_link()).select("a", "b").dropDuplicates(), "stars")
    found = materialize(copies.unionAll(confirmed(stars, docs, width)), "links")
    labels = connected_components(found)
    # Members of a key that are not connected yet, pairwise.
    labelled = members.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = materialize(labelled, "labelled")
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") != F.col("high")).select("key")
    rest = labelled.join(materialize(open_keys, "open-keys"), "key").join(nodes.drop(*SIGNATURE), "node")
    rest = materialize(rest, "rest")
    side = lambda p: rest.select("key", F.col("node").alias(p), F.col("pivot").alias(f"{p}_pivot"), F.col("component").alias(f"{p}_c"), F.col("n").alias(f"{p}_n"), *[F.col(s).alias(f"{p}_{s}") for s in PARITY])
    apart = (F.col("a") < F.col("b")) & (F.col("a") != F.col("a_pivot")) & (F.col("a_c") != F.col("b_c"))
    pairs = materialize(side("a").join(side("b"), "key").where(apart & _may_link()).select("a", "b").dropDuplicates(), "pairs")
    more = materialize(confirmed(pairs, docs, width), "more-links")
    if more.limit(1).count():
        labels = connected_components(found.unionAll(more))
    whole = signed.select("doc_id", F.col("n").alias("n_shingles")).join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int) -> DataFrame:
    """docs with one document of each component; of rows that share a doc_id, one.

    Of rows that share a doc_id the one of the smallest text stays (null first).
    Rows of a null doc_id stay.
    """
    result = materialize(near_duplicates(docs, width), "near-duplicates")
    dropped = result.where(~F.col("kept")).select(F.col("doc_id").alias("__dropped")).dropDuplicates()
    rows = docs.join(broadcast_if_small(materialize(dropped, "dropped")), docs["doc_id"] == F.col("__dropped"), "left_anti")
    repeated = materialize(result.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1).select(F.col("doc_id").alias("__repeated")), "repeated")
    if not repeated.limit(1).count():
        return rows
    again = broadcast_if_small(repeated)
    single = rows.join(again, rows["doc_id"] == F.col("__repeated"), "left_anti")
    first = rows.join(again, rows["doc_id"] == F.col("__repeated"), "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.struct(F.xxhash64("text"), F.col("text"))).alias("row"))
    return single.unionByName(first.select("row.*"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4)


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM shingled),
flat AS (SELECT doc_id, unnest(s) AS g FROM shingled),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * k >= 80 * (p.n + q.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS id, doc_id AS root FROM sizes
  UNION
  SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id WHERE r.root < e.b),
least AS (SELECT id AS doc_id, min(root) AS component_id FROM reach GROUP BY id)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN least USING (doc_id)
"""
