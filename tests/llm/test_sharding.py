import math
import zlib
from collections import Counter
from hashlib import md5

import pytest

from lumenframe.llm import sharding


def brute_shard(doc_id, leaves):
    """Plain descent through the tree."""
    key = "" if doc_id is None else str(doc_id)

    def draw(level, name, weight):
        u = (int(md5(f"{key}/{level}/{name}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        return -math.log(u) / weight, name

    for position, level in enumerate(("region", "rack", "shard")):
        weights = Counter()
        for leaf in leaves:
            weights[leaf[position]] += leaf[3]
        chosen = min(draw(level, n, w) for n, w in weights.items() if w > 0)[1]
        leaves = [leaf for leaf in leaves if leaf[position] == chosen]
    return leaves[0][2]


def test_edges(edge_docs, edge_rows):
    rows = sharding.shard_documents(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    text = {i: t for i, t in edge_rows}
    slots = {}
    for row in rows:
        assert row["shard"] == brute_shard(row["doc_id"], sharding.topology(8))
        assert row["grown_shard"] == brute_shard(row["doc_id"], sharding.topology(9))
        slots.setdefault(row["shard"], []).append(row["slot"])
        if row["doc_id"] != 11:
            raw = (text[row["doc_id"]] or "").encode()
            assert (row["size"], row["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("shards", [8, 9, 12])
def test_one_more_takes_only_into_itself(spark, shards):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    both = sharding.with_shards(sharding.with_shards(df, "doc_id", sharding.topology(shards)), "doc_id", sharding.topology(shards + 1), "grown").collect()
    moved = [r for r in both if r["shard"] != r["grown"]]
    assert all(r["grown"] == shards for r in moved)
    assert abs(len(moved) - 5000 / (shards + 1)) < 5 * math.sqrt(5000 / (shards + 1))
    counts = Counter(r["shard"] for r in both)
    assert len(counts) == shards and max(counts.values()) < 1.3 * 5000 / shards


def test_weights_and_movement(spark):
    """A heavier shard moves rows within the subtrees that hold it, and in proportion."""
    before = sharding.topology(8)
    after = [(*leaf[:3], 3.0 if leaf[2] == 5 else 1.0) for leaf in before]
    df = spark.range(6000).withColumnRenamed("id", "doc_id")
    both = sharding.with_shards(sharding.with_shards(df, "doc_id", before), "doc_id", after, "grown").collect()
    region, rack = {leaf[2]: leaf[0] for leaf in before}, {leaf[2]: leaf[1] for leaf in before}
    for row in both:
        if region[row["grown"]] != region[row["shard"]]:
            assert region[row["grown"]] == region[5]
        elif rack[row["grown"]] != rack[row["shard"]]:
            assert rack[row["grown"]] == rack[5]
        elif row["grown"] != row["shard"]:
            assert row["grown"] == 5
    assert abs(sum(r["grown"] == 5 for r in both) / 6000 - 0.3) < 0.03


def test_zero_weight_and_empty(spark, no_docs):
    closed = [(*leaf[:3], 0.0 if leaf[2] == 2 else 1.0) for leaf in sharding.topology(4)]
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    assert 2 not in {r["shard"] for r in sharding.with_shards(df, "doc_id", closed).collect()}
    with pytest.raises(ValueError):
        sharding.shard_of(df["doc_id"], [(0, 0, 0, 0.0)])
    assert sharding.shard_documents(no_docs).count() == 0
