import random

import numpy as np
import pytest
from tests.llm.conftest import prose

from lumenframe.llm import neardup
from lumenframe.llm.components import connected_components


def shingles(text, width):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width):
    """{doc_id: component}, rows of a doc_id as one node."""
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_edges(edge_docs, edge_rows):
    found = neardup.near_duplicates(edge_docs, 4).collect()
    assert len(found) == len(edge_rows)
    expected = brute(edge_rows, 4)
    for row in found:
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["kept"]
        else:
            assert row["component_id"] == expected[row["doc_id"]]
            assert row["kept"] == (row["component_id"] == row["doc_id"])
    sizes = {(row["doc_id"], row["n_shingles"]) for row in found}
    assert {(i, len(shingles(t, 4))) for i, t in edge_rows} == sizes


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_large_groups(spark, seed):
    rng = random.Random(seed)
    rows = []
    for group in range(12):
        words = prose(rng, rng.choice([30, 120, 400])).split()
        for _ in range(rng.choice([1, 3, 25])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
            if rng.random() < 0.3:
                words = copy
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert found == brute(rows, 4)


def test_pigeonhole():
    rng = np.random.default_rng(3)
    chunks, chunk = neardup.CHUNKS, neardup.CHUNK
    for _ in range(50):
        a = rng.integers(0, 1024, chunks * chunk)
        b = a.copy()
        for place in rng.choice(chunks * chunk, 2 * chunks - 1, replace=False):
            b[place] ^= 1 + rng.integers(0, 1023)
        assert (a.reshape(chunks, chunk) != b.reshape(chunks, chunk)).sum(axis=1).min() <= 1


def test_signature_holds_the_least_hashes():
    rng = np.random.default_rng(6)
    own = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    packed = neardup.signature(own)
    for at in range(neardup.CHUNKS * neardup.CHUNK):
        least = min(int(x) % 2**32 * int(neardup.MULTIPLIERS[at]) % 2**32 + int(neardup.ADDENDS[at]) & 0xFFFFFFFF for x in own)
        assert int(packed[at // neardup.CHUNK]) >> neardup.SYMBOL * (at % neardup.CHUNK) & 1023 == least >> 3 & 1023


def test_no_link_is_lost_at_the_threshold(spark):
    """1,200 pairs of similarity 0.80 to 0.82, none of them missed."""
    rng, rows, due = random.Random(17), [], []
    while len(due) < 1200:
        words = [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 300))]
        a, b = shingles(" ".join(words), 4), shingles("", 4)
        copy = list(words)
        for at in rng.sample(range(len(words)), len(words)):
            changed = [*copy[:at], f"u{rng.randrange(10**6)}", *copy[at + 1 :]]
            b = shingles(" ".join(changed), 4)
            if 100 * len(a & b) < 80 * len(a | b):
                break
            copy = changed
        b = shingles(" ".join(copy), 4)
        if len(a & b) / len(a | b) <= 0.82:
            due.append(len(rows))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(copy))]
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert [i for i in due if found[i + 1] != i] == []


def test_a_cluster_of_one_template(spark):
    """Texts that share keys by the hundred and similarity 0.5 to 0.75, a few of them linked."""
    rng, words, rows = random.Random(5), prose(random.Random(4), 200, 10**6).split(), []
    for i in range(250):
        copy = list(words)
        for at in rng.sample(range(200), 8):
            copy[at] = f"own{i}x{at}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, rows[i][1] + " end of it") for i in range(0, 250, 50)]
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    expected = brute(rows, 4)
    assert found == expected and len(set(expected.values())) > 200


def test_parity_bounds_difference():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        b = np.concatenate([a[: rng.integers(1, 200)], rng.integers(0, 1 << 63, 30, dtype=np.uint64)])
        bits = np.unpackbits((neardup.parity_sketch(a) ^ neardup.parity_sketch(b)).view(np.uint8)).sum()
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    found = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_without_near_duplicates(edge_docs, edge_rows):
    left = neardup.without_near_duplicates(edge_docs, 5)
    assert left.columns == edge_docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    expected = brute(edge_rows, 5)
    assert sorted(i for i in ids if i is not None) == sorted(i for i, c in expected.items() if i == c)
    assert ids.count(None) == 1


def test_empty(no_docs):
    assert neardup.near_duplicates(no_docs, 4).count() == 0
    assert neardup.without_near_duplicates(no_docs, 4).count() == 0
