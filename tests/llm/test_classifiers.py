import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import prose, with_clashes

from lumenframe.llm import quality, toxicity
from lumenframe.llm.common import rest_crc32

TABLE = "doc_id long, text string"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, rng.choice([40, 150, 400])).split()
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["horridword", "vileword", "nastyword"])
        good = rng.random() < 0.7
        if not good:
            words = rng.choice([[w.upper() + "!!" for w in words], [words[0]] * len(words), [w + rng.choice(["%%%", "***", "&&&"]) for w in words]])
            toxic = False
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    labels += [(None, 1, 1), (5, None, None), (7, 3, 3), (100_000, 0, 1)]
    return with_clashes(spark.createDataFrame(rows, TABLE)), with_clashes(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("module, column", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(labelled, module, column):
    docs, labels = labelled
    model = module.fit(docs, labels)
    scored = module.score_documents(docs, model).join(labels.select("doc_id", column), "doc_id")
    rows = [r for r in scored.collect() if r["held_out"] and r[column] in (0, 1)]
    assert len(rows) > 150
    assert np.mean([r["predicted"] == r[column] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("module, column, modulus, rest", [(toxicity, "toxic", 4, 2), (quality, "quality", 3, 1)])
def test_held_out_labels_are_not_learnt(labelled, module, column, modulus, rest):
    docs, labels = labelled
    flipped = labels.withColumn(column, F.when(rest_crc32(F.col("doc_id"), modulus) == rest, 1 - F.col(column)).otherwise(F.col(column)))
    one = module.score_documents(docs, module.fit(docs, labels)).select("doc_id", "score").collect()
    two = module.score_documents(docs, module.fit(docs, flipped)).select("doc_id", "score").collect()
    assert sorted(one) == sorted(two)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edges(labelled, edge_docs, edge_rows, no_docs, module):
    docs, labels = labelled
    model = module.fit(docs, labels)
    rows = module.score_documents(edge_docs, model).collect()
    assert len(rows) == len(edge_rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (4, 5)}
    assert len(empty) == 1
    assert module.score_documents(no_docs, model).count() == 0
    blank = module.fit(docs, labels.where(F.lit(False)))
    assert {r["score"] for r in module.score_documents(edge_docs, blank).collect()} == {0.5}
    only_one = module.fit(docs, labels.where(F.col("toxic" if module is toxicity else "quality") == 1))
    assert all(r["score"] > 0.5 for r in module.score_documents(edge_docs, only_one).collect())


def test_without_toxic_keeps_columns(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, model).collect()}
    assert sorted(r["doc_id"] for r in left.select("doc_id").collect()) == sorted(i for i, p in scores.items() if not p)


def test_long_texts_in_chunks(monkeypatch):
    text = prose(random.Random(1), 3000)
    whole = toxicity.ngrams(text)
    monkeypatch.setattr(toxicity, "CHUNK", 1000)
    assert np.array_equal(toxicity.ngrams(text), whole)


def test_toxic_words_of_the_long_tail():
    rng = random.Random(8)
    tail = ["".join(rng.choice("abcdefghijklmnopqrstuvxyz") for _ in range(8)) for _ in range(60)]

    def text(toxic):
        words = prose(rng, 60).split()
        for at in rng.sample(range(60), 2 * toxic):  # each word in some 3 % of toxic texts
            words[at] = rng.choice(tail)
        return toxicity.ngrams(" ".join(words))

    y = np.array([1.0] * 300 + [0.0] * 600)
    model = toxicity.fit_model([text(int(label)) for label in y], y, {1: 300, 0: 600})
    found = {label: [1 / (1 + np.exp(-model.log_odds(text(label)))) >= toxicity.THRESHOLD for _ in range(200)] for label in (0, 1)}
    assert np.mean(found[1]) > 0.95 and np.mean(found[0]) < 0.02


def test_features_travel_whole():
    rng = np.random.default_rng(1)
    for n in (0, 1, 8191, 8192, 100_000):
        own = np.sort(rng.choice(1 << toxicity.BITS, n, replace=False)).astype(np.uint32)
        raw = toxicity.packed(own)
        assert np.array_equal(toxicity.unpacked(raw), own) and len(raw) <= 1 + (1 << toxicity.BITS) // 8


def plain_ngrams(text):
    """Hashed n-grams, one at a time."""
    raw = b" " + text.encode().lower() + b" "
    found = set()
    for n in toxicity.SIZES:
        for at in range(len(raw) - n + 1):
            h = 0
            for byte in raw[at : at + n]:
                h = (h * 773 + byte + 1) % 2**32
            found.add(((h ^ n * 77_777) * 2_654_435_761 % 2**32) >> 32 - toxicity.BITS)
    return found


def test_toxicity_against_a_plain_version():
    """Ratios counted text by text, and scores summed feature by feature."""
    texts = [f"w{i % 7} fine words {i % 5}" for i in range(40)] + [f"w{i % 7} vile words {i % 5}" for i in range(40)]
    y = np.repeat([0.0, 1.0], 40)
    model = toxicity.fit_model([toxicity.ngrams(t) for t in texts], y, {0: 40, 1: 40})
    sets = [plain_ngrams(t) for t in texts]
    held = {f: [sum(f in s for s, label in zip(sets, y, strict=True) if label == k) for k in (0, 1)] for f in set().union(*sets)}
    for f, (clean, vile) in held.items():
        ratio = np.log(((vile + 0.5) / 41) / ((clean + 0.5) / 41)) if clean + vile >= toxicity.LEAST_TEXTS else 0.0
        assert model.squared[f] == pytest.approx(ratio * ratio, abs=1e-5)
    for text in ("w1 vile words 2", "w1 fine words 2", "", "nothing known"):
        own = plain_ngrams(text)
        odds = model.bias + sum(float(model.weighted[f]) for f in own) / (1 + sum(float(model.squared[f]) for f in own)) ** 0.5
        assert model.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-5)
    assert model.scores(["w1 vile words 2"])[0] > 0.5 > model.scores(["w1 fine words 2"])[0]


def test_quality_against_a_plain_vote():
    """The nearest of all labelled vectors, found by sorting every cosine, vote one by one."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 30)) + "." for _ in range(40)] + [" ".join(["BUY NOW"] * int(rng.integers(3, 20))) for _ in range(40)]
    y = np.repeat([1.0, 0.0], 40)
    model = quality.fit_model(np.stack([quality.terms(t) for t in texts]), y, {0: 40, 1: 40})
    for text in ("alpha beta gamma.", "BUY NOW BUY NOW", "alpha BUY NOW beta", ""):
        latent = model.weighted(quality.terms(text)[None])[0].astype(float) @ model.axes.astype(float)
        cosines = [float(np.dot(latent, v)) / max(float(np.linalg.norm(latent)), 1e-9) for v in model.vectors.astype(float)]
        near = sorted(range(len(cosines)), key=lambda k: -cosines[k])[: quality.NEIGHBOURS]
        votes = [max(cosines[k], 0.0) ** quality.POWER for k in near]
        due = sum(v * y[k] for v, k in zip(votes, near, strict=True)) / sum(votes) if sum(votes) else model.base
        assert model.scores([text])[0] == pytest.approx(due, abs=1e-3)


def test_fit_holds_features_once(monkeypatch):
    """The bytes that came to the driver go as they are unpacked; a feature takes 12 bytes in the rounds."""
    raw = [toxicity.packed(np.arange(i, i + 50, dtype=np.uint32)) for i in range(40)]
    monkeypatch.setattr(toxicity, "usable_labels", lambda *a: None)
    monkeypatch.setattr(toxicity, "labelled_features", lambda *a: (raw, np.arange(40) % 2 * 1.0, {0: 20, 1: 20}))
    toxicity.fit(None, None)
    assert raw == []
    block = toxicity._block([np.arange(5)], np.arange(5), np.ones(5, np.int64), np.ones(5, np.float32))
    assert sum(part.itemsize for part in block) == 12
