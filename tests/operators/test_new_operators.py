import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import session
from lumenframe.functions import options, timebase
from lumenframe.operators import loudness, matching, ranks, reads, recurrences, selection, segments
from lumenframe.sources import render


def test_k_weighting_against_a_plain_filter(spark):
    """A batch boundary inside a channel changes nothing; silence stays silent."""
    rng = np.random.default_rng(2)
    samples = {1: rng.standard_normal(300), 2: np.zeros(50)}
    rows = [(c, i, float(x)) for c, own in samples.items() for i, x in enumerate(own)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        found = loudness.k_weighted(spark.createDataFrame(rows, "c long, i long, x double"), ["c"], "i", "x", 48_000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for channel, own in samples.items():
        y = own
        for b0, b1, b2, a1, a2 in loudness.biquads(48_000):
            out = []
            for i, x in enumerate(y):
                older = [(y[i - k] if i >= k else 0.0, out[i - k] if i >= k else 0.0) for k in (1, 2)]
                out.append(b0 * x + b1 * older[0][0] + b2 * older[1][0] - a1 * older[0][1] - a2 * older[1][1])
            y = out
        mine = [r["weighted"] for r in sorted(found, key=lambda r: r["i"]) if r["c"] == channel]
        assert mine == pytest.approx(list(y), abs=1e-12)


def test_weighted_blocks_leave_the_low_channel_out(spark):
    rows = [(1, c, i, 1.0 if c == 3 else math.sin(i)) for c in range(6) for i in range(400)]
    df = spark.createDataFrame(rows, "s long, c int, i long, x double")
    whole = {r["block"]: r["power"] for r in loudness.weighted_blocks(df, ["s"], "c", "i", "x", 48_000, 6, 100).collect()}
    without = {r["block"]: r["power"] for r in loudness.weighted_blocks(df.where("c <> 3"), ["s"], "c", "i", "x", 48_000, 6, 100).collect()}
    assert whole == pytest.approx(without) and len(whole) == 4


def test_surrounding_is_linear_and_bucketed(spark):
    keys = spark.range(0, 100_000, 7).select(F.lit(1).alias("s"), F.col("id").alias("at"), F.col("id").cast("double").alias("v"))
    points = spark.range(0, 100_000).select(F.lit(1).alias("s"), F.col("id").alias("at"))
    plain = matching.surrounding(points, keys, ["s"], "at", "v")
    dealt = matching.surrounding(points, keys, ["s"], "at", "v", lambda at: F.floor(at / 1000))
    assert plain.exceptAll(dealt).count() == 0 and plain.count() == 100_000
    row = dealt.where("at = 1000").first()
    assert (row["prev_at"], row["next_at"]) == (994, 1001)
    assert dealt.where("at = 99999").first()["next_at"] is None


def test_a_repeated_value_is_dealt_over_ranges(spark):
    df = spark.range(0, 4000).select(F.lit(5.0).alias("v"), F.col("id"))
    assert ranks.in_ranges(df.repartition(4), ["v", "id"]).select("__range").distinct().count() >= 1
    found = ranks.with_rank(df, ["v", "id"]).where("rank0 <> id or total_rows <> 4000")
    assert found.count() == 0


def test_skyline_over_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(c), float(v)) for i, (c, v) in enumerate(zip(rng.integers(0, 400, 3000), rng.integers(0, 10_000, 3000), strict=True))]
    found = {r["i"] for r in selection.skyline(spark.createDataFrame(rows, "i long, c double, v double"), "c", "v", "i").collect()}
    expected, best = set(), -1.0
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        if v > best:
            best = v
            expected.add(i)
    assert found == expected


def test_folds_carry_their_state_over_batches(spark):
    rows = [(s, i, i % 3 == 0) for s in (1, 2, None) for i in range(100)]
    df = spark.createDataFrame(rows, "s long, i long, ok boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        states = recurrences.circuit_breaker(df, ["s"], "i", "ok", 2, 2, 10).collect()
        cuts = recurrences.spaced_cuts(df, ["s"], "i", "ok", 10).where("cut").collect()
        ordered = recurrences.jitter_buffered(df.withColumn("at", F.col("i").bitwiseXOR(F.lit(3))), ["s"], "i", "at", 8, 50).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in (1, 2, None):
        mine = [r["breaker"] for r in sorted(states, key=lambda r: r["i"]) if r["s"] == s]
        assert mine == recurrences.breaker_states([(i, i % 3 == 0) for i in range(100)], 2, 2, 10)
        assert sorted(r["i"] for r in cuts if r["s"] == s) == [12, 24, 36, 48, 60, 72, 84, 96]
        assert [r["at"] for r in sorted(ordered, key=lambda r: r["released"]) if r["s"] == s] == list(range(100))


def test_no_shared_folder_is_an_error_on_a_cluster():
    class Unset:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Unset()

        class _jsc:
            @staticmethod
            def sc():
                class Java:
                    def getCheckpointDir(self):
                        class None_:
                            def isDefined(self):
                                return False

                        return None_()

                return Java()

    class Session:
        conf, sparkContext = Unset(), Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_option_set_and_timecodes(spark):
    text = "ffmpeg -i a.mov -vn -c:a copy -aspect 16:9 -t 5 -to 1:00 o.mkv"
    row = spark.range(1).select(options.option_set(F.lit(text)).alias("o"), timebase.add_frames(F.lit("00:00:00:05"), F.lit(-6), 25).alias("under"), timebase.add_frames(F.lit("23:59:59:24"), F.lit(1), 25).alias("wrap")).first()
    own = row["o"].asDict(recursive=True)
    assert (own["inputs"], own["output"], own["no_video"], own["copy_audio"], own["audio_codec"]) == (["a.mov"], "o.mkv", True, True, None)
    assert (own["aspect_ratio"], own["duration"], own["end_time"], own["crf"], own["overwrite"]) == ("16:9", 5.0, 60.0, None, False)
    assert (row["under"], row["wrap"]) == (None, "00:00:00:00")


def test_playlist_tags(spark):
    df = spark.createDataFrame([(1, 0, 4.0, "a.m4s", "2024-01-02 03:04:05"), (1, 1, 3.5, "b.m4s", "2024-01-02 03:04:05")], "r long, sequence int, duration double, uri string, d string").withColumn("d", F.to_timestamp("d"))
    text = render.media_playlist(df, ["r"], ended=False, kind="EVENT", part_target=0.5, date="d", init="i.mp4").first()["playlist"].split("\n")
    assert text[:4] == ["#EXTM3U", "#EXT-X-VERSION:7", "#EXT-X-TARGETDURATION:4", "#EXT-X-MEDIA-SEQUENCE:0"]
    assert text[4:] == ["#EXT-X-PART-INF:PART-TARGET=0.500000", "#EXT-X-PLAYLIST-TYPE:EVENT", "#EXT-X-PROGRAM-DATE-TIME:2024-01-02T03:04:05+00:00", '#EXT-X-MAP:URI="i.mp4"', "#EXTINF:4.000000,", "a.m4s", "#EXTINF:3.500000,", "b.m4s"]


def test_reads_of_nothing(spark):
    none = spark.createDataFrame([], "k long, s long, p long")
    assert reads.last_parts(none, ["k"], "s", "p").count() == 0
    assert reads.cache_stats(none, F.col("p")).first().asDict() == {"streams": 0, "bytes": 0}


def test_telecine_pattern(spark):
    alternating = [0.5] + [0.0, 0.4] * 5
    late = [0.5] * 5 + [0.0, 0.4, 0.01, 0.4, 0.5, 0.5, 0.5]
    streams = {"film": alternating, "late": late, "three of four": [None, 0.0, 0.4, 0.4, 0.4, 0.4, 0.4, 0.4, 0.4, 0.4], "video": [0.3] * 30, "edge": [None, 0.02, 0.4, 0.02, 0.4] * 2, "short": alternating[:9]}
    rows = [(name, i, d) for name, differences in streams.items() for i, d in enumerate(differences)]
    found = {r["s"]: r for r in segments.telecine_pattern(spark.createDataFrame(rows, "s string, i int, d double"), ["s"], ["i"], "d").collect()}
    assert {s: (r["pattern"], r["confidence"]) for s, r in found.items()} == {"film": ("2:2", 1.0), "late": ("2:2", 0.75), "three of four": ("2:2", 0.75), "video": ("none", 0.0), "edge": ("none", 0.0), "short": (None, None)}
    assert (found["film"]["original_fps"], found["film"]["current_fps"], found["film"]["phase"]) == ("24000/1001", "48000/1001", 0)
    empty = segments.telecine_pattern(spark.createDataFrame([], "s string, i int, d double"), ["s"], ["i"], "d")
    assert empty.count() == 0
