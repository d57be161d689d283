import time

import pytest
from pyspark.sql import functions as F

from lumenframe.operators.recurrences import Jitter, Reorder, keep_spaced
from lumenframe.streaming import state

BATCHES = [[(1, 10), (1, 12), (2, 5)], [(1, 11), (2, 7), (1, 9)], [(2, 6), (1, 13), (1, 40)], [(1, 41), (1, 39)]]


def run(spark, tmp_path, schema, batches, build, mode="append"):
    """All rows that a streaming query gives for micro-batches of files, in order."""
    source = f"{tmp_path}/in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/{k}")
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    out = []
    query = build(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return out


def timed(df):
    return df.withColumn("ts", F.timestamp_millis("ms"))


def test_reorder_stream_is_the_fold(spark, tmp_path):
    batches = [[(s, q, float(q), 1000 * k + 1000) for s, q in rows] for k, rows in enumerate(BATCHES)] + [[(3, 0, 0.0, 60_000)], [(3, 1, 1.0, 61_000)]]
    found = run(spark, tmp_path, "stream long, seq long, value double, ms long", batches, lambda df: state.reordered_stream(timed(df), "stream", "seq", "value", 5, "ts"))
    expected = []
    for stream in (1, 2):
        buffer = Reorder(5, None)
        for rows in BATCHES:
            for _, q in sorted(r for r in rows if r[0] == stream):
                expected += [(stream, x, float(x)) for x in buffer.push(q, q)]
        expected += [(stream, x, float(x)) for x in buffer.flush()]
    found = [r for r in found if r[0] < 3]
    assert sorted(found) == sorted(expected)
    assert [q for s, q, _ in found if s == 1] == [q for s, q, _ in expected if s == 1]


def test_rows_behind_a_gap_come_out_of_a_silent_stream(spark, tmp_path):
    batches = [[(1, 1, 1.0, 100), (1, 3, 3.0, 500), (1, 4, 4.0, 900)], [(2, 1, 1.0, 30_000)], [(2, 2, 2.0, 31_000)]]
    found = run(spark, tmp_path, "stream long, seq long, value double, ms long", batches, lambda df: state.reordered_stream(timed(df), "stream", "seq", "value", 5, "ts"))
    assert [q for s, q, _ in found if s == 1] == [1, 3, 4]


def test_cooldown_stream(spark, tmp_path):
    batches = [[(1, "a", p) for p in own] for own in ([1, 3, 9], [10, 14], [30])]
    found = run(spark, tmp_path, "stream long, rule string, place long", batches, lambda df: state.cooled_down_stream(df, "stream", "rule", "place", 8))
    places = [1, 3, 9, 10, 14, 30]
    assert sorted(p for *_, p in found) == [p for p, ok in zip(places, keep_spaced(places, 8), strict=True) if ok]


@pytest.mark.parametrize("late, kept", [("1 minute", 2), ("1 hour", 3)])
def test_late_rows_are_dropped(spark, tmp_path, late, kept):
    rows = lambda *minutes: [(m, float(m)) for m in minutes]
    timed = lambda df: df.withColumn("ts", F.timestamp_seconds(F.col("m") * 60)).withColumn("k", F.lit("x"))
    found = run(spark, tmp_path, "m long, value double", [rows(1), rows(20), rows(21), rows(2), rows(200), rows(300)], lambda df: state.windowed_stream(timed(df), "ts", 600, late, ["k"], "value"))
    assert sum(n for _, _, _, n, _ in found if n) >= kept
    first = [n for start, _, _, n, _ in found if start.minute == 0 and start.hour == 0]
    assert first == [kept - 1]


def test_jitter_stream_orders_and_holds(spark, tmp_path):
    batches = [[(1, 100, 0.0), (1, 50, 1.0)], [(1, 300, 2.0), (1, 200, 3.0)], [(2, 60_000, 9.0)], [(2, 61_000, 9.0)]]
    schema = "stream long, ms long, value double"
    found = run(spark, tmp_path, schema, batches, lambda df: state.jitter_released(timed(df), "stream", "ts", "value", 150, 10, "10 seconds"))
    assert [at for s, at, _ in found if s == 1] == [50, 100, 200, 300]
    buffer, first = Jitter(150, 10), []
    for _, at, _ in (row for rows in batches[:2] for row in rows):
        first += buffer.push(at, at)
    assert first == [50, 100] and buffer.flush() == [200, 300]
    small = Jitter(150, 2)
    assert [small.push(at, at) for at in (100, 120, 110)] == [[], [], []] and small.dropped == 1 and small.flush() == [110, 120]


def test_sync_stream_takes_the_latest_audio(spark, tmp_path):
    def build(df):
        timed = df.withColumn("video_ts", F.timestamp_micros("us"))
        video = timed.where("kind = 'v'").select("stream", "video_ts")
        audio = timed.where("kind = 'a'").select("stream", F.col("video_ts").alias("audio_ts"))
        return state.sync_stream(video, audio, "stream", 50, "1 second")

    rows = [[(1, "v", 1000), (1, "a", 1040), (1, "v", 5000)], [(1, "a", 980), (1, "a", 960), (2, "a", 1000)], [(3, "v", 90_000_000)], [(3, "v", 91_000_000)]]
    assert sorted(run(spark, tmp_path, "stream long, kind string, us long", rows, build)) == [(1, 1000, 980)]
