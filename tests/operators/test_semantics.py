"""Hand-computed cases of what is easily got wrong."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import arrays, hdr, options, scores, timebase
from lumenframe.operators import filters, kernels, loudness, matching, metrics, ranks, regression, rules, segments, selection, windows
from lumenframe.sources import render, subtitles


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(x):
    return F.lit(x)


def test_empty_and_null_aggregates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0)], "k long, v double")
    rows = {r["k"]: r for r in metrics.summary(df, ["k"], ["v"]).collect()}
    assert (rows[1]["avg_v"], rows[1]["min_v"], rows[1]["max_v"]) == (0.0, math.inf, -math.inf)
    none = df.where(F.lit(False))
    assert none.agg(metrics.share(F.col("v") > 0, 100.0, 100.0)).first()[0] == 100.0
    assert none.agg(metrics.integer_mean("k")).first()[0] is None
    assert {r["k"]: r["std_samp"] for r in metrics.bench_stats(df, ["k"], "v", 1).collect()}[2] == 0.0


def test_ssim_mean_compat(spark):
    df = spark.createDataFrame([(1, 40.0, 0.9), (1, None, 0.7)], "k long, p double, s double")
    assert metrics.quality_metrics(df, ["k"], "p", "s").first()["avg_ssim"] == pytest.approx(0.8)
    assert metrics.quality_metrics(df, ["k"], "p", "s", compat=True).first()["avg_ssim"] == pytest.approx(1.6)


def test_infinite_psnr_is_left_out(spark):
    df = spark.createDataFrame([(math.inf,), (30.0,), (None,), (40.0,)], "p double")
    row = df.agg(metrics.finite_mean("p").alias("m"), metrics.finite_min("p").alias("l")).first()
    assert (row["m"], row["l"]) == (35.0, 30.0)


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)] + [("b", 5.0), ("c", None)], "k string, v double")
    rows = {r["k"]: r for r in metrics.nearest_rank(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    assert (rows["a"]["p50"], rows["a"]["p99"], rows["b"]["p99"]) == (51.0, 100.0, 5.0)
    assert "c" not in rows


def test_histogram_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 2.5, 9.0)], "k long, v double")
    rows = {r["le"]: r["cumulative"] for r in metrics.histogram(df, ["k"], "v", [1, 2]).collect()}
    assert rows == {1.0: 1, 2.0: 2, None: 4}


def test_job_states(spark):
    cases = {1: ["completed"] * 2, 2: ["cancelled"] * 2, 3: ["failed", "pending"], 4: ["failed", "running"], 5: ["pending", "completed"]}
    rows = [(j, s, 0.5, "before") for j, states in cases.items() for s in states]
    found = metrics.job_progress(spark.createDataFrame(rows, "j long, s string, p double, b string"), "j", "s", "p", "b")
    assert {r["j"]: r["state"] for r in found.collect()} == {1: "completed", 2: "cancelled", 3: "failed", 4: "running", 5: "before"}


def test_votes(spark):
    df = spark.createDataFrame([(1, [True, True, None]), (1, [False, True, None]), (1, [False, None, None]), (1, [True, False, None])], "k long, bits array<boolean>")
    rows = {r["pos"]: (r["bit"], r["confidence"]) for r in metrics.majority_bits(df, ["k"], "bits").collect()}
    assert rows[0] == (False, 0.5) and rows[1][0] is True and rows[2] == (None, None)


def test_single_point_series(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, 4.0)], "k long, t string, i long, v double").withColumn("t", F.to_timestamp("t"))
    row = windows.series_stats(df, ["k"], "t", "v", "i").first()
    assert (row["std_dev"], row["rate_of_change"], row["latest"]) == (0.0, None, 4.0)


def test_threshold_counts_its_own_score(spark):
    values = [0.2] * 9 + [0.9, 0.2]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k long, i long, v double")
    rows = [r["threshold"] for r in windows.adaptive_threshold(df, ["k"], ["i"], "v").orderBy("i").collect()]
    assert rows[8] == 0.3 and rows[9] == pytest.approx(np.mean(values[:10]) + 2 * np.std(values[:10]))


def test_skyline_against_a_fold(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(20), float(rng.randrange(50))) for i in range(200)]
    best, expected = -math.inf, []
    for i, c, v in sorted(rows, key=lambda r: (r[1], r[0])):
        if v > best:
            best = v
            expected.append(i)
    assert sorted(r["i"] for r in selection.skyline(spark.createDataFrame(rows, "i long, c int, v double"), "c", "v", "i").collect()) == sorted(expected)


def test_even_samples(spark):
    df = spark.range(10).withColumnRenamed("id", "i")
    assert [r["i"] for r in selection.evenly_sampled(df, ["i"], 2, 4).orderBy("i").collect()] == [0, 2, 5, 7]
    assert selection.evenly_sampled(df, ["i"], 20, 30).count() == 10


def test_global_ranks(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.0, 2.0, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, v double")
    found = {r["i"]: (r["rank0"], r["total_rows"]) for r in ranks.with_rank(df, ["v", "i"]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert found == {i: (k, 500) for k, (i, _) in enumerate(order)}
    assert ranks.with_rank(df.where(F.lit(False)), ["v", "i"]).count() == 0


def test_as_of_without_a_match(spark):
    left = spark.createDataFrame([(1, 5, 1.0), (1, 1, 2.0), (2, 9, 3.0)], "k long, t long, v double")
    right = spark.createDataFrame([(1, 5, 7.0, 1), (1, 4, 8.0, 2), (1, 5, 9.0, 2)], "k long, t long, w double, i long")
    found = {(r["k"], r["t"]): (r["right_ts"], r["right_value"]) for r in matching.as_of(left, right, ["k"], "t", "w", "i").collect()}
    assert found == {(1, 5): (5, 9.0), (1, 1): (None, None), (2, 9): (None, None)}


def test_interpolation_modes(spark):
    keys = spark.createDataFrame([(1, 0, 0.0), (1, 10, 10.0)], "k long, t long, v double")
    points = spark.createDataFrame([(1, -5), (1, 0), (1, 4), (1, 15)], "k long, t long")
    near = matching.surrounding(points, keys, ["k"], "t", "v")
    rows = {r["t"]: (r["l"], r["s"]) for r in near.select("t", matching.interpolated(near, "t").alias("l"), matching.interpolated(near, "t", "step").alias("s")).collect()}
    assert rows == {-5: (0.0, 0.0), 0: (0.0, 0.0), 4: (4.0, 0.0), 15: (10.0, 10.0)}


def test_concat_keeps_nulls_and_checks_columns(spark):
    part = spark.createDataFrame([(0, 4), (None, 4), (4, 4)], "pts long, d long")
    found = sorted((r["file_index"], r["pts"]) for r in segments.concatenated([part, part], "pts", "d").collect() if r["pts"] is not None)
    assert found == [(0, 0), (0, 4), (1, 8), (1, 12)]
    with pytest.raises(ValueError):
        segments.concatenated([part, part.withColumnRenamed("d", "e")], "pts", "d")


def test_rule_language(spark):
    facts = spark.createDataFrame([(1, "abc", "7"), (2, None, "x")], "k long, name string, n string")
    rule = lambda *c: [rules.ComplianceRule("r", "A", "error", tuple(rules.Condition(*x) for x in c))]
    run = lambda *c: {(r["k"], r["field"]) for r in rules.rule_violations(facts, rule(*c), "k", ["A"]).collect()}
    assert run(("name", "exists")) == {(2, "name")}
    assert run(("name", "eq", "x"), ("n", "gt", "5")) == {(1, "name"), (2, "n")}
    assert run(("n", "le", "0")) == {(1, "n")}
    assert run(("name", "matches", "b")) == set()
    assert run(("name", "matches", "(")) == {(1, "name")}
    assert run(("gone", "gt", "1")) == set() and run(("gone", "exists")) == {(1, "gone"), (2, "gone")}
    passed = {r["k"]: r["passed"] for r in rules.compliant(facts, rule(("name", "exists")), "k", ["A"]).collect()}
    assert passed == {1: True, 2: False}


def test_selectors(spark):
    df = spark.createDataFrame([(0, 0, "video", 0), (0, 1, "audio", 0), (0, 2, "audio", 1), (1, 0, "video", 0)], "file_index int, stream_index int, stream_type string, type_index int")
    count = lambda s: df.where(rules.stream_selector(s)).count()
    assert [count(s) for s in ("", "v", "a:1", "0:v", "1:v:0", "2")] == [4, 2, 1, 1, 1, 1]
    with pytest.raises(ValueError):
        rules.stream_selector("v:0:1")


def test_timecodes(spark):
    cases = {1799: "00:00:59;29", 1800: "00:01:00;02", 17982: "00:10:00;00"}
    df = spark.createDataFrame([(f,) for f in range(0, 40_000, 7)] + [(f,) for f in cases], "f long")
    rows = df.select("f", timebase.drop_frame_timecode(F.col("f"), "29.97").alias("t")).withColumn("b", timebase.drop_frame_to_frame(F.col("t"), "29.97")).collect()
    assert all(r["b"] == r["f"] for r in rows)
    assert {r["f"]: r["t"] for r in rows if r["f"] in cases} == cases


def test_rescale_truncates(spark):
    row = one(spark, timebase.rescale(lit(-7).cast("long"), 1, 2, 1, 1).alias("a"), timebase.rescale(lit(2**62).cast("long"), 1, 90000, 1, 90000).alias("b"), timebase.rescale(lit(None).cast("long"), 1, 2, 1, 1).alias("c"))
    assert tuple(row) == (-3, 2**62, None)
    with pytest.raises(ValueError):
        timebase.rescale(lit(1), 10**10, 1, 1, 10**10)


def test_time_texts(spark):
    row = one(spark, timebase.parse_srt(lit("00:00:01,5")).alias("a"), timebase.parse_srt(lit("bad")).alias("b"), timebase.parse_vtt(lit("01:02.003")).alias("c"), timebase.parse_ass(lit("0:00:01.50")).alias("d"), timebase.format_srt(lit(3_723_004).cast("long")).alias("e"))
    assert tuple(row) == (1005, None, 62_003, 1500, "01:02:03,004")


def test_option_texts(spark):
    row = one(
        spark, options.bitrate(lit("2.5M")).alias("a"), options.bitrate(lit("-1k")).alias("b"), options.seconds(lit("1:02:03.5")).alias("c"), options.resolution(lit("HD720")).alias("d"), options.aspect_ratio(lit("1.85")).alias("e"), options.aspect_ratio(lit("1.777")).alias("f"), options.container(lit("M4V")).alias("g"),
        options.trace_parent(lit("01-" + "a" * 32 + "-" + "b" * 16 + "-01")).alias("h"), options.query_parameter(lit("?a=1&b=2"), "b").alias("i"), options.color(lit("#0F8")).alias("j"), options.cloud_url(lit("s3://b/x/y")).alias("k"),
    )
    assert (row["a"], row["b"], row["c"], tuple(row["d"]), row["e"], row["f"], row["g"], row["h"], row["i"]) == (2_500_000, None, 3723.5, (1280, 720), "185:100", "16:9", "mp4", None, "2")
    assert tuple(row["j"]) == (0, 255, 136, 255) and tuple(row["k"]) == ("s3", "b", "x/y")


def test_scores(spark):
    c = [lit(x) for x in (0.5, 0.5, 0.5, 0.03)]
    row = one(spark, scores.linear_to_db(lit(0.0)).alias("a"), scores.profile_complexity(*c).alias("b"), scores.overall_quality(lit(math.inf), lit(None).cast("double"), lit(None).cast("double")).alias("c"), scores.overall_quality(*[lit(None).cast("double")] * 3).alias("d"), scores.pq_eotf(lit(1.0)).alias("e"))
    assert row["a"] == -math.inf and row["c"] == 100.0 and row["d"] == 0.0 and row["e"] == pytest.approx(10000)
    assert row["b"] == min(0.5 * 0.35 + 0.5 * 0.30 + 0.5 * 0.20 + 0.03 * 0.15, 1)


def test_array_kernels(spark):
    a, b = F.array(*[lit(x) for x in (1, 2, 3, 4)]), F.array(*[lit(x) for x in (1, 2, 3, 8)])
    row = one(
        spark, arrays.mse(a, b).alias("a"), arrays.psnr(arrays.mse(a, a)).alias("b"), arrays.mse(a, F.slice(b, 1, 2)).alias("c"), arrays.flip_rows(a, 2).alias("d"), arrays.flip_columns(a, 2).alias("e"), arrays.transpose(a, 2).alias("f"), arrays.crop(a, 2, 1, 0, 1, 2).alias("g"),
        arrays.blend_many(F.array(a.cast("array<double>"), b.cast("array<double>")), [1, 3]).alias("h"), arrays.downmix(F.array(a.cast("array<double>"), b.cast("array<double>")), [[0.5, 0.5]]).alias("i"), arrays.zero_crossings(F.array(lit(1.0), lit(-1.0), lit(-2.0))).alias("j"),
    )
    assert (row["a"], row["b"], row["c"]) == (4.0, math.inf, None)
    assert (row["d"], row["e"], row["f"], row["g"]) == ([2, 1, 4, 3], [3, 4, 1, 2], [1, 3, 2, 4], [2, 4])
    assert row["h"] == [1, 2, 3, 7] and row["i"] == [[1, 2, 3, 6]] and row["j"] == 0.5


def test_loudness_of_silence_and_two_halves(spark):
    quiet = [(1, i, 0.0) for i in range(40)]
    halves = [(2, i, 0.5 if i < 40 else 0.001) for i in range(80)]
    blocks = loudness.block_powers(spark.createDataFrame(quiet + halves, "k long, n long, v double"), ["k"], "n", "v", 4)
    rows = {r["k"]: r["integrated"] for r in loudness.integrated(blocks, ["k"]).collect()}
    assert rows[1] == -math.inf and rows[2] == pytest.approx(-0.691 + 10 * math.log10(0.25))


def test_filter_strings(spark):
    assert filters.split_guarded("a='1,2',b=[x,y],c\\,d", ",") == ["a='1,2'", "b=[x,y]", "c\\,d"]
    f = filters.Filter.parse("[0:v]scale=w=640:h=-1[out]")
    assert (f.name, f.named, f.inputs, f.outputs) == ("scale", {"w": "640", "h": "-1"}, ("0:v",), ("out",))
    assert len(filters.parse_graph("a,b;c")) == 2
    assert filters.supported_share(filters.parse_chain("scale=1:1,unknown")) == 0.5
    with pytest.raises(ValueError):
        filters.compile_chain(filters.parse_chain("unknown"))
    with pytest.raises(ValueError):
        filters.register("scale", lambda f: None)
    base = spark.createDataFrame([(0, [0.0, 10.0]), (1, [5.0, 5.0])], "frame long, data array<double>")
    out = filters.run_graph({"a": base, "b": base}, "[a][b]overlay=0.5,hflip=2[o]")["o"]
    assert {r["frame"]: r["data"] for r in out.collect()} == {0: [10.0, 0.0], 1: [5.0, 5.0]}
    loud = spark.createDataFrame([([1.0],)], "samples array<double>")
    assert filters.apply(loud, "volume=20dB").first()[0] == [10.0]


def test_kernels():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 255, (32, 32)).astype(float)
    assert kernels.ssim(a, a) == pytest.approx(1) and kernels.ms_ssim(a, a) == pytest.approx(1) and kernels.vmaf_like(a, a) == pytest.approx(100)
    b = np.clip(a + rng.normal(0, 25, a.shape), 0, 255)
    assert kernels.ssim(a, b) < 0.99 and kernels.vmaf_like(a, b) < 99
    assert kernels.motion_field(a, np.roll(a, 2, axis=1), 8, 3)[5] == (2, 0)
    assert kernels.scaled(a, 32, 32) == pytest.approx(a)
    assert kernels.average_hash(np.arange(64.0).reshape(8, 8)) == (1 << 32) - 1
    assert kernels.sobel(np.ones((4, 4))).sum() == 0
    assert len(kernels.resampled(np.arange(10.0), 10, 20)) == 20
    assert np.allclose(kernels.bilateral(np.ones((4, 4)), 1, 1), 1) and np.allclose(kernels.deinterlaced(np.ones((4, 4))), 1) and np.allclose(kernels.unsharp(np.ones((4, 4)), 1), 1)


def test_subtitle_texts(spark):
    srt = "1\r\n00:00:01,000 --> 00:00:02,000\r\nHello\r\nthere\r\n\r\n2\r\nbad --> worse\r\nx\r\n"
    vtt = "WEBVTT\n\nNOTE no\n\nid\n00:01.000 --> 00:02.500 align:start\nHi\n\n00:xx --> 1\nbad\n"
    ass = "[Script Info]\nScriptType: v4.00+\n[Events]\nDialogue: 0,0:00:01.00,0:00:02.50,Default,,0,0,0,,{\\b1}Hi, you\\Nthere\n"
    df = spark.createDataFrame([(1, srt), (2, vtt), (3, ass), (4, ""), (5, None)], "k long, t string")
    kinds = {r["k"]: r["f"] for r in df.select("k", subtitles.detect_format(F.col("t")).alias("f")).collect()}
    assert kinds == {1: "srt", 2: "vtt", 3: "ass", 4: "srt", 5: "srt"}
    rows = lambda d: [(r["k"], r["start_ms"], r["end_ms"], r["text"]) for r in d.collect()]
    assert rows(subtitles.parse_srt_cues(df.where("k = 1"), "k", "t")) == [(1, 1000, 2000, "Hello\nthere")]
    with pytest.raises(Exception, match="bad time line"):
        subtitles.parse_srt_cues(df.where("k = 1"), "k", "t", strict=True).collect()
    assert rows(subtitles.parse_vtt_cues(df, "k", "t")) == [(2, 1000, 2500, "Hi")]
    assert rows(subtitles.parse_ass_cues(df, "k", "t")) == [(3, 1000, 2500, "Hi, you\nthere")]


def test_edit_lists(spark):
    csv = 'source,in,out,rin,rout\n"a.mov",1,2,3,4\nshort,1\n'
    cmx = "TITLE: x\n001  REEL1 V C 00:00:01:00 00:00:02:12 00:00:00:00 00:00:01:12\nnonsense\n"
    listing = "# c\nfile 'a.mp4'\nduration 2.5\nfile b.mp4\ninpoint 1\n"
    df = spark.createDataFrame([(1, csv), (2, cmx), (3, listing)], "k long, t string")
    assert [tuple(r)[2:] for r in subtitles.parse_edl_csv(df, "k", "t").collect()] == [("a.mov", "1", "2", "3", "4")]
    assert [tuple(r)[1:] for r in subtitles.parse_cmx3600(df, "k", "t", 24.0).collect()] == [(1, "REEL1", "V", "C", 1.0, 2.5, 0.0, 1.5)]
    assert [tuple(r)[1:] for r in subtitles.parse_concat_list(df.where("k = 3"), "k", "t").collect()] == [(0, "a.mp4", 2.5, None, None), (1, "b.mp4", None, 1.0, None)]


def test_labels_are_escaped(spark):
    row = one(spark, render.labels_text(F.create_map(lit("b"), lit('say "x"\n'), lit("a"), lit("\\"))).alias("t"))
    assert row["t"] == '{a="\\\\",b="say \\"x\\"\\n"}'


def test_regression(spark):
    rng = np.random.default_rng(2)
    rows = [(float(x), float(3 + 2 * x)) for x in rng.random(200)]
    df = spark.createDataFrame(rows, "x double, y double")
    w = regression.fit(df, ["x"], "y", rate=0.5, rounds=3000, ridge=0.0)
    assert w == pytest.approx([3, 2], abs=1e-3)
    assert max(regression.cross_validated(df, ["x"], ["x"], "y", 4, rate=0.5, rounds=2000, ridge=0.0)) < 0.02
    assert regression.fit(df.where(F.lit(False)), ["x"], "y").tolist() == [0, 0]


def test_rate_conversions(spark):
    rows = [(24.0, 30.0), (30.0, 24.0), (24.0, 25.0), (25.0, 25.0), (25.0, 50.0), (10.0, 10.005), (10.0, 12.0), (10.0, 20.0)]
    found = [r[0] for r in spark.createDataFrame(rows, "a double, b double").select(scores.suggested_conversion(F.col("a"), F.col("b"))).collect()]
    assert found == ["Telecine", "InverseTelecine", "SpeedChange", "DropDuplicate", "Blend", "DropDuplicate", "Blend", "MotionCompensated"]


def test_scaling(spark):
    rows = [(5, 0, 0), (0, 0, 0), (10, 4, 4), (1, 1, 10), (3, 2, 4)]
    found = [r[0] for r in spark.createDataFrame([(p, a, r or None) for p, a, r in rows], "p int, a int, r int").select(scores.scaling_target(F.col("p"), F.col("a"), F.col("r"))).collect()]
    assert found[2:] == [5, 2, 4]


def test_audio_types(spark):
    rows = [(0.0, 0.5, 100.0), (0.5, 0.2, 500.0), (0.5, 0.01, 5000.0), (0.5, 0.07, 2000.0)]
    found = [r[0] for r in spark.createDataFrame(rows, "a double, b double, c double").select(scores.audio_type(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert found == ["Silence", "Speech", "Music", "Mixed"]


def test_tone_curves(spark):
    row = one(spark, hdr.reinhard(lit(4.0), 4.0).alias("a"), hdr.filmic(lit(hdr.FILMIC_WHITE)).alias("b"), hdr.tone_mapped(lit(0.0), lit(0.0), lit(0.0), hdr.filmic, 1000.0, 100.0).alias("c"), hdr.tone_mapped(lit(9.0), lit(0.0), lit(0.0), hdr.reinhard, 1000.0, 100.0, 0.5, 1.0).alias("d"))
    assert row["a"] == pytest.approx(1) and row["b"] == pytest.approx(1) and tuple(row["c"]) == (0.0, 0.0, 0.0)
    assert 0 < row["d"]["g"] < row["d"]["r"]


def test_tiles_round_trip():
    a = np.random.default_rng(1).random((37, 50))
    parts = kernels.tiles(a, 16, 4)
    assert all(t.shape == (16, 16) for _, _, t in parts)
    assert kernels.merged_tiles(parts, 50, 37, 4) == pytest.approx(a)
    assert kernels.merged_tiles(kernels.tiles(a[:5, :5], 16, 4), 5, 5, 4) == pytest.approx(a[:5, :5])
