"""Random inputs against plain folds."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.operators import filters, matching, segments, selection, windows
from lumenframe.operators.recurrences import Reorder, keep_spaced, merge_short, split_long


@given(st.lists(st.integers(0, 60), max_size=80), st.integers(1, 10))
def test_reorder_keeps_order_and_loses_only_what_it_counts(seqs, limit):
    buffer, out = Reorder(limit, None), []
    for at, s in enumerate(seqs):
        out += buffer.push(s, (s, at))
    out += buffer.flush()
    assert len(out) + buffer.dropped == len(seqs)
    assert len({at for _, at in out}) == len(out)


@given(st.lists(st.integers(0, 1000), max_size=60), st.integers(1, 50))
def test_kept_places_are_spaced(places, gap):
    places = sorted(places)
    kept = [p for p, ok in zip(places, keep_spaced(places, gap), strict=True) if ok]
    assert all(b - a >= gap for a, b in zip(kept, kept[1:], strict=False))
    assert not places or kept[0] == places[0]


CUES = st.lists(st.tuples(st.integers(0, 2000), st.integers(1, 4000), st.text("ab é", min_size=1, max_size=40)), max_size=15)


@given(CUES, st.integers(100, 3000), st.integers(5, 40))
def test_splitting_keeps_words_and_time(parts, longest, most):
    at, cues = 0, []
    for gap, length, text in parts:
        cues.append({"start_ms": at + gap, "end_ms": at + gap + length, "text": text, "confidence": 1.0})
        at += gap + length
    for out in (split_long(cues, longest, most), merge_short(cues, longest, most)):
        assert " ".join(c["text"] for c in out).split() == " ".join(c["text"] for c in cues).split()
        assert all(a["end_ms"] <= b["start_ms"] for a, b in zip(out, out[1:], strict=False))
    if cues:
        assert (out[0]["start_ms"], out[-1]["end_ms"]) == (cues[0]["start_ms"], cues[-1]["end_ms"])


@given(st.text("ab,;[]'\"\\=:", max_size=40))
def test_guarded_splitting_loses_nothing(text):
    assert ",".join(filters.split_guarded(text, ",")) == text


@pytest.mark.parametrize("seed", range(3))
@settings(deadline=None)
@given(st.just(0))
def test_windows_against_folds(spark, seed, _):
    rng = random.Random(seed)
    rows = [(k, i, float(rng.randrange(100))) for k in range(4) for i in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    by = {k: [v for kk, _, v in rows if kk == k] for k in range(4)}
    moved = {(r["k"], r["i"]): r["moving_average"] for r in windows.moving_average(df, ["k"], ["i"], "v", 3).collect()}
    copies = {}
    for r in segments.drop_duplicate(df, ["k"], ["i"], 0.7).collect():
        copies[r["k"], r["i"]] = copies.get((r["k"], r["i"]), 0) + 1
    for k, values in by.items():
        for i in range(len(values)):
            own = values[max(0, i - 2) : i + 1]
            assert moved[k, i] == pytest.approx(sum(own) / len(own))
            assert copies.get((k, i), 0) == int((i + 1) * 0.7) - int(i * 0.7)


def test_pareto_keeps_no_dominated_point(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(30), float(rng.randrange(100)), rng.choice("abc")) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, cost int, v double, g string")
    front = selection.pareto_front(df, "cost", "v", "i", 20.0, 60.0, ["g"]).collect()
    assert len({r["g"] for r in front}) == len(front)
    for r in front:
        assert r["v"] >= 20 and not any(c < r["cost"] and v >= r["v"] for _, c, v, _ in rows)


@pytest.mark.parametrize("bucket", [None, lambda t: F.floor(t / 7)])
def test_as_of_against_a_fold(spark, bucket):
    rng = random.Random(6)
    left = [(rng.randrange(3), rng.randrange(100), i) for i in range(100)]
    right = [(rng.randrange(3), rng.randrange(100), float(i), i) for i in range(60)]
    found = {r["i"]: (r["right_ts"], r["right_value"]) for r in matching.as_of(spark.createDataFrame(left, "k long, t long, i long"), spark.createDataFrame(right, "k long, t long, w double, o long"), ["k"], "t", "w", "o", bucket).collect()}
    for k, t, i in left:
        best = max(((rt, o, w) for rk, rt, w, o in right if rk == k and rt <= t), default=(None, None, None))
        assert found[i] == (best[0], best[2])


def test_empty_frames(spark):
    none = spark.createDataFrame([], "k long, i long, v double")
    for df in (windows.moving_average(none, ["k"], ["i"], "v", 3), segments.drop_duplicate(none, ["k"], ["i"], 1.5), selection.skyline(none, "i", "v", "k"), windows.gop_types(none, ["k"], ["i"], "v"), segments.tumbling(none.withColumn("d", F.col("v")), "d", 10)):
        assert df.count() == 0
