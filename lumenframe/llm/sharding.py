"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard levels. At each level every child draws
-ln(u) / weight, u in (0, 1) from a digest of the row's key, the level and the
child's name, and the smallest draw wins; a child wins in proportion to its
weight. Draws of children whose weight is unchanged stay what they were, so a
changed weight moves rows only into or out of the subtrees that contain it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.llm.common import only
from lumenframe.session import table

#: (region, rack, shard, weight)
Leaf = tuple[int, int, int, float]

#: Slots are numbered in this many pieces a shard; the offsets are
#: SLOT_PIECES x shards rows, whatever the input.
SLOT_PIECES = 1024


def topology(shards: int, shards_per_rack: int = 2, racks_per_region: int = 2, planned: int = 8) -> list[Leaf]:
    """A tree of equal shards.

    The planned shards fill racks and regions. Every later shard comes in a
    region of its own: then the only weight that changes is the new region's,
    and one more shard takes rows only into itself.
    """
    leaves = []
    per_region = shards_per_rack * racks_per_region
    regions = -(-planned // per_region)
    for shard in range(shards):
        if shard < planned:
            leaves.append((shard // per_region, shard // shards_per_rack, shard, 1.0))
        else:
            later = shard - planned
            leaves.append((regions + later, planned + later, shard, 1.0))
    return leaves


def _draw(key: Column, level: str, name: int, weight: float) -> Column:
    digest = F.md5(F.concat(key, F.lit(f"/{level}/{name}")))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    return F.struct((-F.log(u) / F.lit(weight)).alias("draw"), F.lit(name).alias("name"))


def _winner(key: Column, level: str, weights: dict[int, float]) -> Column:
    names = [n for n in sorted(weights) if weights[n] > 0]
    if not names:
        raise ValueError(f"no child of weight above 0 at level {level}")
    if len(names) == 1:
        return F.lit(names[0])
    return F.array_min(F.array(*[_draw(key, level, n, weights[n]) for n in names]))["name"]


def _grouped(leaves: Sequence[Leaf], position: int) -> dict[int, list[Leaf]]:
    found: dict[int, list[Leaf]] = {}
    for leaf in leaves:
        found.setdefault(leaf[position], []).append(leaf)
    return found


def _descend(key: Column, leaves: Sequence[Leaf], position: int, levels: Sequence[str]) -> Column:
    """The child at this level, then the same in the subtree below it."""
    children = _grouped(leaves, position)
    weights = {n: sum(leaf[3] for leaf in own) for n, own in children.items()}
    winner = _winner(key, levels[position], weights)
    if position == 2:
        return winner
    below = {n: _descend(key, own, position + 1, levels) for n, own in children.items() if weights[n] > 0}
    if len(below) == 1:
        return next(iter(below.values()))
    branches = sorted(below.items())
    return reduce(lambda chain, item: chain.when(winner == F.lit(item[0]), item[1]), branches[1:], F.when(winner == F.lit(branches[0][0]), branches[0][1]))


def shard_of(key: Column, leaves: Sequence[Leaf]) -> Column:
    """The shard of a key in a tree of leaves. A null key draws as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return _descend(text, leaves, 0, ("region", "rack", "shard")).cast("int")


def with_shards(df: DataFrame, key: str, leaves: Sequence[Leaf], name: str = "shard") -> DataFrame:
    """df with the shard of each row; no shuffle."""
    return df.withColumn(name, shard_of(F.col(key), leaves))


def with_slots(df: DataFrame, shard: str, order: Sequence[str], name: str = "slot", pieces: int = SLOT_PIECES) -> DataFrame:
    """Gapless numbers from 0 in each shard, without gathering a shard in one task.

    Rows are dealt over `pieces` pieces a shard by a hash of `order`, counted by
    piece, and numbered from the piece's offset in the order of `order`. Rows
    equal in `order` get their numbers in any order. The offsets are at most
    pieces x shards rows and are broadcast.
    """
    piece = (F.conv(F.substring(F.md5(F.concat_ws("/", *order)), 1, 8), 16, 10).cast("long") % pieces).cast("int")
    pieced = df.withColumn("__piece", piece)
    counts = pieced.groupBy(F.col(shard).alias("__shard"), F.col("__piece").alias("__at")).agg(F.count("*").alias("__n"))
    before = W.partitionBy("__shard").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__shard", "__at", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    own = W.partitionBy(shard, "__piece").orderBy(*order)
    numbered = pieced.withColumn("__row", F.row_number().over(own))
    joined = numbered.join(F.broadcast(offsets), (F.col(shard) == F.col("__shard")) & (F.col("__piece") == F.col("__at")))
    return joined.withColumn(name, (F.col("__from") + F.col("__row") - 1).cast("long")).drop("__piece", "__shard", "__at", "__from", "__row")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Documents with their shard, slot and the shard they would have with one more.

    size: UTF-8 bytes of the text plus 1; a null text has none, so 1, and
    text_crc32 0. The law is `key`: doc_id and the number of shards decide, so
    repeated rows of a doc_id share a shard and take neighbouring slots. A null
    doc_id is a key of its own. Other columns of docs are not looked at.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = only(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"), shard_of(F.col("doc_id"), topology(shards)).alias("shard"), shard_of(F.col("doc_id"), topology(shards + 1)).alias("grown_shard")
    )
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def _sql_winner(level: str, weights: dict[int, float]) -> str:
    draw = "-ln((('0x' || substr(md5(k || '/{level}/{name}'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656) / {weight}::DOUBLE"
    draws = [f"{{'d': {draw.format(level=level, name=n, weight=weights[n])}, 'n': {n}}}" for n in sorted(weights)]
    return str(next(iter(weights))) if len(weights) == 1 else f"list_sort([{', '.join(draws)}])[1].n"


def _sql_shard(leaves: Sequence[Leaf], position: int = 0) -> str:
    children = _grouped(leaves, position)
    winner = _sql_winner(("region", "rack", "shard")[position], {n: sum(leaf[3] for leaf in own) for n, own in children.items()})
    if position == 2:
        return winner
    return f"CASE {winner} " + " ".join(f"WHEN {n} THEN {_sql_shard(own, position + 1)}" for n, own in sorted(children.items())) + " END"


def _sql_crc32(text: str) -> str:
    """CRC-32 of a text's bytes, byte by byte over the usual table."""
    table_of = [reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), i) for i in range(256)]
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, ({table_of}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_sql_crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
s AS (SELECT doc_id, size, text_crc32, ({_sql_shard(topology(8))})::INTEGER AS shard, ({_sql_shard(topology(9))})::INTEGER AS grown_shard,
  ('0x' || substr(md5(concat_ws('/', doc_id, text_crc32, size)), 1, 8))::BIGINT % {SLOT_PIECES} AS piece FROM d)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY piece, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s
"""
