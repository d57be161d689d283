import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenframe.llm import packing


def brute_cost(positions, penalties, window):
    best = {0: 0}
    last = len(positions) - 1
    for j in range(1, len(positions)):
        options = [best[i] + (0 if j == last else window - (positions[j] - positions[i]) + penalties[j]) for i in range(j) if positions[j] - positions[i] <= window and i in best]
        best[j] = min(options)
    return best[last]


def cost(cuts, positions, penalties, window):
    return sum(window - (positions[j] - positions[i]) + penalties[j] for i, j in itertools.pairwise(cuts) if j != len(positions) - 1)


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_of_least_cost(seed):
    rng = random.Random(seed)
    window = rng.randint(3, 20)
    positions = np.cumsum([0] + [rng.randint(1, min(window, 6)) for _ in range(rng.randint(1, 25))])
    penalties = np.array([rng.choice([0, 2, 8]) for _ in positions])
    cuts = packing.best_cuts(positions, penalties, window)
    assert cuts[0] == 0 and cuts[-1] == len(positions) - 1
    assert all(positions[j] - positions[i] <= window for i, j in itertools.pairwise(cuts))
    assert cost(cuts, positions, penalties, window) == brute_cost(positions, penalties, window)


def test_tail_is_powers_of_two():
    assert packing.tail_lengths(1500, 2048) == [1024, 256, 128, 64, 16, 8, 4]
    assert packing.tail_lengths(2048, 2048) == [2048]


def rebuilt(rows):
    docs = {}
    for row in sorted(rows, key=lambda r: (str(r["doc_id"]), r["start"])):
        docs.setdefault(row["doc_id"], []).append(row)
    return docs


@pytest.mark.parametrize("window", [2048, 64])
def test_round_trip(edge_docs, edge_rows, window):
    rows = packing.pack_documents(edge_docs, window=window).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = rebuilt(rows)
    for doc_id, text in edge_rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        if doc_id in (11, 12):
            continue
        own = pieces[doc_id]
        assert [i for row in own for i in packing.unpack_ids(row["ids"])] == ids
        assert {row["doc_tokens"] for row in own} == {len(ids)}
    assert sum(len(packing.unpack_ids(r["ids"])) for r in rows if r["doc_id"] == 12) == 2 * (len(tokenizer.encode("same row").ids) + 1)
    by_sequence = {}
    for row in rows:
        by_sequence.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1]
        assert sum(n for _, n in own) <= window


def test_runs_are_joined(edge_docs, monkeypatch):
    whole = packing.pack_documents(edge_docs.coalesce(1)).collect()
    monkeypatch.setattr(packing, "RUN_IDS", 5000)
    cut = packing.pack_documents(edge_docs.coalesce(1)).collect()
    assert sum(r["length"] for r in cut) == sum(r["length"] for r in whole)
    lengths = {}
    for row in cut:
        lengths[row["sequence_id"]] = lengths.get(row["sequence_id"], 0) + row["length"]
    padding = sum(packing.WINDOW - n for n in lengths.values() if n & (n - 1))
    assert padding < 0.02 * sum(lengths.values())


def test_empty(no_docs):
    assert packing.pack_documents(no_docs).count() == 0


def test_special_token_text(spark):
    text = "a <|endoftext|> b"
    row = packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [i for r in row for i in packing.unpack_ids(r["ids"])] == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "x \t" + "\t" * 1_000_000 + "y", "a" * 2_000_000, "7" * 2_000_000], ids=["blanks", "lines", "tabs", "letters", "digits"])
def test_long_runs(spark, text):
    rows = packing.pack_documents(spark.createDataFrame([(1, text), (2, "after it")], "doc_id long, text string").coalesce(1)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = rebuilt(rows)
    assert [i for r in own[1] for i in packing.unpack_ids(r["ids"])] == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert [i for r in own[2] for i in packing.unpack_ids(r["ids"])] == [*tokenizer.encode("after it", add_special_tokens=False).ids, 1]


def test_cuts_stand_at_sentences(spark):
    """No window ends inside a sentence that fits a window."""
    rng = random.Random(9)
    texts = [" ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(3, 40))) + rng.choice(".!?") for _ in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(texts[i * 30 : i * 30 + 30])) for i in range(100)], "doc_id long, text string").coalesce(1)
    _, ends = packing._tokenizer(None)
    rows = sorted(packing.pack_documents(docs).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    last = {r["sequence_id"]: r for r in rows}
    full = [r for s, r in last.items() if s < max(last) - 12]  # the rest at the end is cut to powers of two
    assert len(full) > 5
    for row in full:
        ids = packing.unpack_ids(row["ids"])
        assert ids[-1] == packing.END_ID or ends[ids[-1]]


def test_inner_cuts():
    assert packing.inner_cuts(np.array([0, 5, 45, 60]), 40).tolist() == []
    assert packing.inner_cuts(np.array([0, 5, 46, 60]), 40).tolist() == [21, 37]
