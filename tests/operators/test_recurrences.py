import random

import pytest

from lumenframe.operators import recurrences as rec


def plain_spaced(places, gap, last):
    out = []
    for p in places:
        if last is None or p >= last + gap:
            out.append(True)
            last = p
        else:
            out.append(False)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_cooldown(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(3), rng.choice("ab"), rng.randrange(100), 7) for _ in range(80)]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "stream long, rule string, place long, cooldown int")
    found = sorted(tuple(r) for r in rec.cooled_down(df, ["stream", "rule"], "place", "cooldown").collect())
    expected = []
    for stream in range(3):
        for rule in "ab":
            places = sorted(p for s, r, p, _ in rows if (s, r) == (stream, rule))
            expected += [(stream, rule, p, 7) for p, ok in zip(places, plain_spaced(places, 7, None), strict=True) if ok]
    assert found == sorted(expected)


def test_first_cut_counts_from_zero(spark):
    df = spark.createDataFrame([(1, p, True) for p in (3, 12, 20, 24, 40)] + [(1, 30, None)], "stream long, place long, candidate boolean")
    cuts = {r["place"] for r in rec.spaced_cuts(df, ["stream"], "place", "candidate", 12).collect() if r["cut"]}
    assert cuts == {12, 24, 40}


CUE = {"start_ms": 0, "end_ms": 500, "text": "a", "confidence": 1.0}


def test_merge_short():
    cues = [{**CUE, "end_ms": 5000}, {**CUE, "start_ms": 5100, "end_ms": 5400, "text": "b", "confidence": 0.5}, {**CUE, "start_ms": 9000, "end_ms": 9100, "text": "c"}]
    merged = rec.merge_short(cues, 1000, 200)
    assert [(c["text"], c["start_ms"], c["end_ms"], c["confidence"]) for c in merged] == [("a b", 0, 5400, 0.75), ("c", 9000, 9100, 1.0)]


def test_split_long_leaves_the_first_half():
    cue = {**CUE, "end_ms": 8000, "text": " ".join(f"w{i}" for i in range(8))}
    out = rec.split_long([cue], 3000, 10_000)
    assert [c["text"] for c in out] == ["w0 w1 w2 w3", "w4 w5", "w6 w7"]
    assert out[0]["end_ms"] == 4000 and out[-1]["end_ms"] == 8000
    assert rec.split_long([{**CUE, "end_ms": 9000}], 3000, 10)[0]["text"] == "a"
    wide = {**CUE, "text": "ééééé ééééé"}
    assert len(rec.split_long([wide], 3000, 12)) == 2


def test_cue_frames(spark):
    df = spark.createDataFrame([(1, 0, 0, 500, "a", 1.0), (1, 1, 600, 900, "b", 0.5), (2, 0, 0, 9000, "x y", 1.0)], "doc long, ord int, start_ms long, end_ms long, text string, confidence double")
    assert sorted((r["doc"], r["text"]) for r in rec.merged_cues(df, "doc", "ord", 1000, 200).collect()) == [(1, "a b"), (2, "x y")]
    assert sorted((r["doc"], r["idx"], r["text"]) for r in rec.split_cues(df, "doc", "ord", 5000, 100).collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "x"), (2, 1, "y")]


def test_reorder():
    buffer = rec.Reorder(3, None)
    out = [buffer.push(s, s) for s in (10, 12, 11, 9, 13)]
    assert out == [[10], [], [11, 12], [], [13]] and buffer.dropped == 1
    assert buffer.push(15, 15) == []
    assert buffer.push(30, 30) == [15, 30] and buffer.expected == 31
    full = rec.Reorder(2)
    for s in (0, 2, 3):
        full.push(s, s)
    assert full.push(9, 9) == [2, 3] and full.dropped == 1 and full.expected == 10
    assert rec.Reorder(16).push(5, 5) == [] and rec.Reorder(16).push(17, 17) == [17]


def test_breaker():
    calls = [(0, True), (1, False), (2, False), (3, True), (12, True), (13, True), (14, False), (15, True)]
    assert rec.breaker_states(calls, 2, 2, 10) == ["closed", "closed", "open", "open", "half_open", "closed", "closed", "closed"]
    assert rec.breaker_states([(0, False), (1, False), (20, False), (21, True)], 2, 1, 10) == ["closed", "open", "open", "open"]


def test_rungs(spark):
    df = spark.createDataFrame([(1, 4, 4000, 95.0), (1, 3, 3900, 94.0), (1, 2, 2000, 60.0), (1, 1, 1000, 80.0)], "t long, o int, kbps int, vmaf double")
    assert sorted(r["kbps"] for r in rec.kept_rungs(df.withColumn("o", -df["o"]), ["t"], ["o"], "kbps", "vmaf", 500, 70.0).collect()) == [1000, 4000]
