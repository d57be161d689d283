import random

import pytest
from tests.llm.conftest import prose
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_neardup import brute as components

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lumenframe.llm import packing, toxicity  # noqa: E402
from lumenframe.llm.pii import DEMONSTRATION_KEY, Pseudonyms  # noqa: E402


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    items = [(i, prose(rng, 25)) for i in range(5)]
    docs, labels = [], []
    for i in range(300):
        words = prose(rng, 90).split()
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(4):
                words[rng.randrange(90)] = rng.choice(["horridword", "vileword"])
        text = " ".join(words)
        if rng.random() < 0.1:
            text += " " + items[rng.randrange(5)][1]
        if rng.random() < 0.2:
            text += f" call +1 (212) 555-{rng.randrange(10**4):04d}"
        if docs and rng.random() < 0.2:
            text = docs[rng.randrange(len(docs))][1] + rng.choice(["", " tail"])
        docs.append((i, text, "en", "src", len(text)))
        labels.append((i, 1, int("horridword" in text or "vileword" in text)))
    docs += [(1000, None, None, None, None), (1001, "", "en", "src", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "doc_tokens").collect()]

    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    rows = [(i, t) for i, t, *_ in docs if model.scores([t or ""])[0] < toxicity.THRESHOLD]
    own = components(rows, corpus_pipeline.SHINGLE_WORDS)
    rows = [(i, t) for i, t in rows if own[i] == i]
    leaked = {d for d, _ in leaks(rows, items)}
    assert leaked and len(rows) < len(docs) - 50
    rows = [(i, None if t is None else Pseudonyms(DEMONSTRATION_KEY).text(t)[0]) for i, t in rows if i not in leaked]
    encode, _ = packing._tokenizer(None)
    expected = {i: len(encode(t or "")) + 1 for i, t in rows}
    assert {(d, n) for d, _, _, n in found} == set(expected.items())
    for doc_id, tokens in expected.items():
        at = 0
        for _, start, length, _ in sorted(p for p in found if p[0] == doc_id):
            assert start == at
            at += length
        assert at == tokens


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]


def test_empty_tables_and_nulls(spark, tmp_path):
    for name, rows in (("empty", []), ("nulls", [(None, None, None, None, None), (1, None, None, None, None), (2, "a b", None, None, None), (2, "a b", None, None, None)])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(None, None, None)] * len(rows), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(None, None)] * len(rows), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        found = [(r["doc_id"], r["start"]) for r in corpus_pipeline.run(spark, folder).collect()]
        assert {d for d, _ in found} == {d for d, *_ in rows}
        assert [d for d, s in found if s == 0].count(2) == (1 if rows else 0)
