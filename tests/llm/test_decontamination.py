import random

from pyspark.sql import functions as F
from tests.llm.conftest import prose, with_clashes

from lumenframe.llm import decontamination as dc


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs, items):
    out = {}
    for d, t in docs:
        for i, u in items:
            s, own = shingles(t), shingles(u)
            if d is not None and i is not None and own and 100 * len(s & own) >= 80 * len(own):
                out[d, i] = max(out.get((d, i), (0,)), (len(s & own) / len(own), len(own), len(s & own)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.choice([6, 12, 30, 60]))) for i in range(15)] + [(90, None), (91, ""), (92, "four words only here"), (None, prose(rng, 20)), (93, prose(rng, 9)), (93, prose(rng, 9))]
    docs = []
    for i in range(60):
        words = prose(rng, rng.choice([0, 3, 40, 3000])).split()
        own = items[rng.randrange(15)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            own[rng.randrange(len(own))] = "changed"
        at = rng.randrange(len(words) + 1)
        docs.append((i, " ".join(words[:at] + own + words[at:]) if rng.random() < 0.7 else " ".join(words)))
    docs += [(100, None), (101, ""), (3, docs[3][1]), (4, prose(rng, 50)), (None, items[0][1]), (102, items[1][1].upper())]
    df, it = with_clashes(spark.createDataFrame(docs, "doc_id long, text string")), with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    expected = brute(docs, items)
    found = {(r["doc_id"], r["item_id"]): (r["containment"], r["item_shingles"], r["shared"]) for r in dc.contaminated(df, it).collect()}
    assert found == expected and len(found) > 15
    left = dc.decontaminate(df, it)
    assert left.columns == df.columns
    leaked = [bool(brute([(0, t)], items)) for _, t in docs]
    assert leaked[docs.index((None, items[0][1]))]
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in left.collect()) == sorted((str(d), str(t)) for (d, t), gone in zip(docs, leaked, strict=True) if not gone)


def test_native(spark, edge_docs):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    plan = dc.contaminated(edge_docs, items)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_HASHES", 0)
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "x y z")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "b c d e f g")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, items).collect()] == [(1, 5)]


def test_empty(spark, no_docs, edge_docs):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert dc.contaminated(no_docs, items).count() == 0
    assert dc.contaminated(edge_docs, items.where(F.lit(False))).count() == 0
