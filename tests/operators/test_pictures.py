"""Edge-directed lines, predictions, reports, pages and stream checks on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import filters, kernels, regression, segments
from lumenframe.sources import edit_xml, render, streams


def _edge_directed_slowly(c, p, n, keep_top):
    h, w = len(c), len(c[0])
    out = [list(row) for row in c]
    for y in range(h):
        if (y % 2 == 0) == keep_top:
            continue
        up = y - 2 if y >= 2 else (0 if keep_top else 1)
        down = y + 2 if y + 2 < h else (h - 1 if keep_top else h - 2)
        for x in range(w):
            lo, hi = max(x - 1, 0), min(x + 1, w - 1)
            ends = [(c[up][x], c[down][x]), (c[up][hi], c[down][lo]), (c[up][lo], c[down][hi])]
            a, b = min(ends, key=lambda e: abs(e[0] - e[1]))
            space, time = (a + b + 1) // 2, (p[y][x] + n[y][x] + 1) // 2
            d, e = c[max(y - 1, 0)][x], c[min(y + 1, h - 1)][x]
            moved = max(abs(d - p[y][x]), abs(e - n[y][x]), abs(c[y][x] - time))
            around = d, e, p[y][x], n[y][x]
            out[y][x] = space if abs((d + e) // 2 - space) > moved else min(max(time, min(around)), max(around))
    return out


@pytest.mark.parametrize("keep_top", [True, False])
def test_edge_directed_lines(keep_top):
    rng = np.random.default_rng(7)
    for shape in ((8, 8), (5, 9), (4, 4)):
        c, p, n = (rng.integers(0, 256, shape) for _ in range(3))
        assert kernels.edge_directed(c, p, n, keep_top).tolist() == _edge_directed_slowly(c.tolist(), p.tolist(), n.tolist(), keep_top)
    still = rng.integers(0, 256, (6, 6))
    assert kernels.edge_directed(still, still, still, keep_top, spatial=False).tolist() == still.tolist()
    assert kernels.edge_directed(still).shape == still.shape


def test_null_pictures(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, None)], "id int, d array<double>")
    made = {r["id"]: r["m"] for r in df.select("id", kernels.picture_kernel(kernels.halved)(F.col("d"), F.lit(2)).alias("m")).collect()}
    assert made == {1: [2.5], 2: None}


def test_prediction_bounds(spark):
    df = spark.createDataFrame([(3840, 2160, "AV1", 100.0, 1.0), (320, 240, "none", 60.0, 0.0), (1920, 1080, None, 93.0, 0.5)], "w int, h int, codec string, target double, complexity double")
    rows = regression.with_encoding_prediction(df, F.col("w"), F.col("h"), F.lit(30.0), F.col("codec"), F.col("target"), F.col("complexity")).collect()
    assert [r["crf"] for r in rows] == [16.5, 35.0, 23.0]
    assert rows[2]["kbps"] == 5000 and rows[2]["min_kbps"] == 3000 and rows[2]["max_kbps"] == 7500
    assert all(200 <= r["min_kbps"] <= r["kbps"] <= r["max_kbps"] <= 40_000 and 40 <= r["vmaf"] <= 100 for r in rows)


def test_support_of_texts_is_that_of_chains(spark):
    texts = ["scale=640:-1,fps=30", "hflip,warp=a", "drawtext=text='a,hflip',vflip", "nothing"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", filters.supported_share_of(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in rows} == {t: filters.supported_share(filters.parse_chain(t)) for t in texts}


def test_report_of_nothing_and_of_nulls(spark):
    schema = "p string, t string, s string, ms long"
    none = render.report_lines(spark.createDataFrame([], schema), "p", "t", "s", "ms").collect()
    assert [r["line"] for r in sorted(none, key=lambda r: r["place"])] == ["Total: 0", "Passed: 0 (0.0%)", "Failed: 0", "Skipped: 0", "Errors: 0", "Duration: 0ms"]
    rows = render.report_lines(spark.createDataFrame([(None, "a", "passed", 5), ("x", "b", "failed", 7), ("x", None, None, 1)], schema), "p", "t", "s", "ms").collect()
    assert {r["line"] for r in rows if r["section"] == 1} == {": 1 of 1 passed (100.0%), 0 failed", "x: 0 of 2 passed (0.0%), 1 failed"}
    assert {r["line"] for r in rows if r["section"] == 2} == {"[PASS] a 5ms", "[FAIL] b 7ms", "[ERR]  1ms"}


def test_streams_that_do_not_fit(spark):
    schema = "file_index long, stream_index int, track_type string, codec string, width int, height int, sample_rate int, channels int"
    first = [(0, 0, "video", "h264", 640, 480, None, None), (0, 1, "audio", "aac", None, None, 48_000, 2)]
    rows = first + [(1, 0, "video", "h264", 640, 480, None, None), (2, 0, "video", "h264", 640, 360, None, None), (2, 1, "video", "aac", None, None, 48_000, 2), (3, 0, "video", None, 640, 480, None, None), (3, 1, "audio", "aac", None, None, 44_100, 1)]
    df = spark.createDataFrame(rows, schema)
    found = lambda strict: {(r["file_index"], r["stream_index"], r["problem"]) for r in segments.incompatible_streams(df, strict).collect()}
    loose = {(1, None, "stream count"), (2, 1, "track_type"), (3, 0, "codec")}
    assert found(False) == loose
    assert found(True) == loose | {(2, 0, "resolution"), (3, 1, "sample_rate")}
    assert segments.incompatible_streams(df.limit(0), True).collect() == []


def test_title_of_an_edit_list(spark):
    other = '<xmeml version="5">\n <sequence id="s">\n  <name>A &amp; B</name>\n  <rate><timebase>25</timebase></rate>\n  <media><video><track><clipitem id="c"><name>x</name><in>25</in><out>50</out></clipitem></track></video></media></sequence></xmeml>'
    texts = spark.createDataFrame([(1, other), (2, other.replace('<clipitem id="c">', "<clipitem>"))], "k int, xml string")
    rows = edit_xml.parse_edit_xml(texts, "k", "xml").collect()
    assert {(r["k"], r["title"], r["source"], r["source_in"], r["source_out"]) for r in rows} == {(k, "A & B", "x", 1.0, 2.0) for k in (1, 2)}


def test_playlist_without_optional_columns(spark):
    df = spark.createDataFrame([("t", 5, 10, 20, "a"), ("t", 9, None, None, "b")], "t string, bandwidth long, width int, height int, uri string")
    assert render.master_playlist(df, ["t"]).first()["playlist"].split("\n")[3:] == ["#EXT-X-STREAM-INF:BANDWIDTH=9", "b", "#EXT-X-STREAM-INF:BANDWIDTH=5,RESOLUTION=10x20", "a"]


def test_files_of_streams_and_segments(spark, tmp_path):
    for name, data in (("one.264", b"abc"), ("two.h264", b"z"), ("empty.264", b""), ("three.txt", b"x"), ("deep/four.264", b"y")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert {(r["stream_id"], r["length"]) for r in streams.load_streams(spark, str(tmp_path)).collect()} == {("one", 3), ("two", 1)}
    assert {r["stream_id"] for r in streams.load_streams(spark, str(tmp_path), deep=True).collect()} == {"one", "two", "four"}
    rows = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 2.0), ("b", 0, 1.0)], "r string, i int, d double")
    render.write_segments(render.segments(rows, ["r"], "i", "d"), str(tmp_path / "out"), ["r"])
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["r=a", "r=b"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
