import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import prose, with_clashes

from lumenframe.llm import lm


class Plain:
    """The pretrained model in dictionaries, one byte at a time."""

    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        for text in texts:
            data = lm.END * lm.ORDER + lm.message(lm.tokens(text))
            for at in range(lm.ORDER, len(data)):
                for size in range(lm.ORDER + 1):
                    self.counts[data[at - size : at]][data[at]] += 1
        self.full, self.left = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        for context, own in self.counts.items():
            n, q = sum(own.values()), len(own)
            if n == 1:
                continue
            for symbol, c in own.items():
                case = self.full[len(context), self.cls(n - 1, q - (c == 1))]
                case[0] += c
                case[1] += c if c == 1 else 0
                if context and c == 1:
                    rest = {s: k for s, k in self.counts[context[1:]].items() if s not in own}
                    others = self.counts[context[1:]][symbol] - 1
                    m, d = sum(rest.values()) + others, len(rest) + (others > 0)
                    if m:
                        case = self.left[len(context), self.cls(m, d)]
                        case[0] += 1
                        case[1] += others == 0

    @staticmethod
    def cls(n, q):
        return tuple(x if x <= 4 else math.floor(4 * math.log2(x) - 4) for x in (n, q))

    def escape(self, table, size, n, q):
        cases, escapes = table.get((size, self.cls(n, q)), (0, 0))
        return (escapes + lm.PRIOR_CASES * q / (n + q)) / (cases + lm.PRIOR_CASES)

    def log10_of(self, context, symbol):
        total, excluded, above = 0.0, set(), None
        for size in range(lm.ORDER, -1, -1):
            own = self.counts.get(context[len(context) - size :])
            if own is None:
                continue
            rest = {s: c for s, c in own.items() if s not in excluded}
            n, q = sum(rest.values()), len(rest)
            if n:
                e = self.escape(self.full, size, n, q) if above is None else self.escape(self.left, above, n, q)
                if not size and len(own) == 256:
                    e = 0.0
                if symbol in rest:
                    return total + math.log10(rest[symbol] / n * (1 - e))
                total += math.log10(e)
            excluded |= own.keys()
            above = size
        return total - math.log10(256 - len(excluded))

    def score(self, text):
        data = lm.END * lm.ORDER + lm.message(lm.tokens(text))
        return sum(self.log10_of(data[at - lm.ORDER : at], data[at]) for at in range(lm.ORDER, len(data)))


def texts(seed, n):
    rng = random.Random(seed)
    return [prose(rng, rng.choice([0, 3, 40, 150]), 60) + rng.choice(["", " Ümlaut", " RARE" + str(rng.random())]) for _ in range(n)]


@pytest.mark.parametrize("grams, words", [(10**6, 10**6), (300, 5), (0, 0)])
def test_against_plain_model(spark, grams, words):
    trained, scored = texts(1, 40), [*texts(2, 12), None, "", " \n", "zzzz\x00qqq 東京", "same", "same"]
    docs = with_clashes(spark.createDataFrame([(i, t) for i, t in enumerate(trained)] + [(90, None)], "doc_id long, text string"))
    model = lm.train(docs)
    counts = Counter(w for t in [*trained, None] for w in [*lm.tokens(t), lm.END])
    total, distinct = sum(counts.values()), len(counts)
    assert (model.total, model.distinct) == (total, distinct)
    rows = [(i if i else None, t) for i, t in enumerate(scored)]
    found = {r["doc_id"]: r for r in lm.score_documents(with_clashes(spark.createDataFrame(rows, "doc_id long, text string")), model, grams, words).collect()}
    assert len(found) == len(rows)
    plain = Plain([*trained, None])
    for doc_id, text in rows:
        own, row = [*lm.tokens(text), lm.END], found[doc_id]
        assert row["n_tokens"] == len(own)
        assert row["n_known"] == sum(counts[w] > 0 for w in own)
        assert row["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own), rel=1e-9)
        assert row["score"] == pytest.approx(plain.score(text), rel=1e-9)


def every_byte(spark, model, contexts):
    """log10 of each byte after each context."""
    grams = [int.from_bytes(c, "big") << 8 | b for c in contexts for b in range(256)]
    keys = spark.createDataFrame([(g,) for g in grams], "key long").join(model.seen(), "key", "left").select("key", "log10").collect()
    found = {r["key"]: r["log10"] for r in keys if r["log10"] is not None}
    rest = spark.createDataFrame([(g,) for g in grams if g not in found], "key long")
    found |= {r["key"]: r["log10"] for r in model.escaping(rest).collect()}
    return [[found[int.from_bytes(c, "big") << 8 | b] for b in range(256)] for c in contexts]


def test_probabilities_add_up(spark):
    model = lm.train(spark.createDataFrame([(t,) for t in texts(3, 30)], "text string"))
    for row in every_byte(spark, model, [b"\n\n\n\n\n", b"  w1 ", b"qqqqq", b"w1 w2", b"\xff\xff\xff w"]):
        assert sum(10.0**x for x in row) == pytest.approx(1, abs=1e-9)


def test_segments_do_not_matter(monkeypatch):
    messages = [lm.message(lm.tokens(t)) for t in texts(4, 20)]
    whole = np.concatenate([lm._grams(p) for p in lm._segments(messages)])
    monkeypatch.setattr(lm, "SEGMENT", 37)
    assert np.array_equal(np.concatenate([lm._grams(p) for p in lm._segments(messages)]), whole)


def test_hash_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    table = lm.HashTable(keys, np.arange(len(keys), dtype=float))
    values, found = table.find(keys)
    assert found.all() and np.array_equal(values, np.arange(len(keys)))
    assert not lm.HashTable(keys[:5], np.zeros(5)).find(keys[5:])[1].any()
    assert not lm.HashTable(keys[:0], np.zeros(0)).find(keys)[1].any()


def test_adaptive_code_learns():
    text = prose(random.Random(7), 300, 20)
    assert lm.AdaptivePPM().code(text) > 0.6 * lm.AdaptivePPM().code(text, learn=False)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    model = lm.train(edge_docs)
    assert lm.score_documents(edge_docs, model).count() == len(edge_rows)
    assert lm.score_documents(no_docs, model).count() == 0
    untrained = lm.train(no_docs)
    rows = {r["doc_id"]: r for r in lm.score_documents(edge_docs, untrained).collect()}
    assert rows[5]["score"] == pytest.approx(-math.log10(256)) and rows[5]["n_known"] == 0


def test_counts_of_a_partition_are_let_go_in_parts(monkeypatch):
    """A task holds a bounded number of counts, and no tables of an earlier model."""
    rng = random.Random(3)
    texts = [prose(rng, 200, 300) for _ in range(40)]
    monkeypatch.setattr(lm, "SEGMENT", 500)
    monkeypatch.setattr(lm, "HELD_COUNTS", 1000)
    lm.worker_cache()["shared"] = {"lm-grams": ("old", None)}
    most, found = 0, Counter()
    held = lm._Counts.add

    def add(self, keys):
        nonlocal most
        out = held(self, keys)
        most = max(most, self.held)
        return out

    monkeypatch.setattr(lm._Counts, "add", add)
    rows = list(lm._count_partition([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    assert "shared" not in lm.worker_cache()
    for batch in rows:
        for kind, key, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found[kind, key] += n
    expected = Counter()
    for text in texts:
        data = lm.END * lm.ORDER + lm.message(lm.tokens(text))
        expected.update((1, int.from_bytes(data[at - lm.ORDER : at + 1])) for at in range(lm.ORDER, len(data)))
        expected.update((0, int(h)) for h in lm._word_hashes(lm.tokens(text)).view(np.int64))
    assert found == expected
    assert most <= 1000 < len(expected)
