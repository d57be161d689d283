"""Further queries: texts, scores, timecodes, filters, kernels and small reads, most of them one expression a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lumenframe.functions import arrays, options, scores, timebase
from lumenframe.operators import filters, loudness, metrics, reads, recurrences, rules, selection
from lumenframe.plans.queries import ORDER, U, _alerts, _cues, _CUES, _METRIC, events, query, r6, rounded
from lumenframe.session import table
from lumenframe.sources import render, subtitles


def numbered(*values: str):
    """The value whose place (from 0) a number is, in SQL and in Spark."""
    return F.array(*[F.lit(v) for v in values])


# Texts


@query("SELECT event_id, printf('%d:%02d:%02d.%02d', e // 360000, (e // 6000) % 60, (e // 100) % 60, e % 100) AS ass, e * 10 AS ms FROM (SELECT event_id, event_id * 97 AS e FROM events)")
def ass_times(spark, sf_dir):
    e = F.col("e")
    d = lambda n: F.call_function("div", e, F.lit(n))
    own = events(spark, sf_dir).select("event_id", (F.col("event_id") * 97).alias("e")).select("event_id", F.format_string("%d:%02d:%02d.%02d", d(360_000), d(6000) % 60, d(100) % 60, e % 100).alias("ass"))
    return own.withColumn("ms", timebase.parse_ass(F.col("ass")))


@query("SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'vtt' WHEN 1 THEN 'ass' WHEN 2 THEN 'ssa' WHEN 3 THEN 'srt' ELSE 'ass' END AS format FROM conversations")
def subtitle_formats(spark, sf_dir):
    heads = numbered("WEBVTT\n\n", "[Script Info]\nScriptType: v4.00+\n", "﻿[Script Info]\nScriptType: v4.00\n", "1\n00:00:01,000 --> 00:00:02,000\n", " \n[Script Info]\n")
    own = table(spark, sf_dir, "conversations")
    return own.select("conv_id", "turn", subtitles.detect_format(F.concat(F.get(heads, (F.col("turn") % 5).cast("int")), F.col("text"))).alias("format"))


@query(f"WITH {_CUES} SELECT conv_id, turn, trunc(start_ms * 1.25)::BIGINT AS start_ms, trunc(end_ms * 1.25)::BIGINT AS end_ms FROM c")
def cue_stretch(spark, sf_dir):
    return subtitles.stretch(_cues(spark, sf_dir), 1.25).select("conv_id", "turn", "start_ms", "end_ms")


@query(f"WITH {_CUES} SELECT conv_id, start_ms // 10 * 10 AS start_ms, end_ms // 10 * 10 AS end_ms, 'turn ' || turn || chr(10) || 'two' AS text, 'Main' AS style FROM c")
def ass_cues(spark, sf_dir):
    """Script texts as editors write them: sections, override codes, forced line ends, commas in the text's field."""
    clock = lambda c: F.format_string("%d:%02d:%02d.%02d", *[F.call_function("div", F.col(c), F.lit(n)) % m for n, m in ((3_600_000, 1000), (60_000, 60), (1000, 60), (10, 100))])
    line = F.concat(F.lit("Dialogue: 0,"), clock("start_ms"), F.lit(","), clock("end_ms"), F.lit(",Main,,0,0,0,,{\\i1}turn "), F.col("turn").cast("string"), F.lit("{\\i0}\\Ntwo"))
    texts = _cues(spark, sf_dir).groupBy("conv_id").agg(F.concat(F.lit("[Script Info]\r\nTitle: x\r\n\r\n[Events]\r\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\r\n"), F.array_join(F.array_sort(F.collect_list(line)), "\r\n")).alias("ass"))
    return subtitles.parse_ass_cues(texts, "conv_id", "ass").select("conv_id", "start_ms", "end_ms", "text", "style")


_EDIT = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)"


def _edit_texts(spark, sf_dir, head, line):
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("no"))))
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("rows"))
    return own.select("l_orderkey", F.concat(F.lit(head), F.array_join(F.transform("rows", line), "\n"), F.lit("\n")).alias("text"))


@query(f"SELECT l_orderkey, {_EDIT}::INTEGER AS line_no, 'clip ' || l_partkey AS source, '0' AS source_in, l_linenumber::VARCHAR AS source_out FROM lineitem")
def edl_csv_rows(spark, sf_dir):
    texts = _edit_texts(spark, sf_dir, "Source,In,Out,Record In,Record Out\n", lambda r, i: F.concat(F.lit('"clip '), r["part"].cast("string"), F.lit('", 0,'), r["no"].cast("string"), F.lit(",5,6,extra")))
    return subtitles.parse_edl_csv(texts, "l_orderkey", "text").select("l_orderkey", "line_no", "source", "source_in", "source_out")


@query(f"SELECT l_orderkey, {_EDIT}::INTEGER AS event, 'R' || l_partkey AS reel, 'V' AS track, 'C' AS transition, round(l_linenumber + 5 / 25.0::DOUBLE, 6) AS source_in, round(l_linenumber + 61.0::DOUBLE, 6) AS source_out FROM lineitem")
def cmx_events(spark, sf_dir):
    line = lambda r, i: F.format_string("%03d  R%d  V     C        00:00:%02d:05 00:01:%02d:00 00:00:00:00 00:00:01:00", i + 1, r["part"], r["no"], r["no"] + 1)
    texts = _edit_texts(spark, sf_dir, "TITLE: A CUT\nFCM: NON-DROP FRAME\n\n", line)
    return rounded(subtitles.parse_cmx3600(texts, "l_orderkey", "text", 25.0).select("l_orderkey", "event", "reel", "track", "transition", "source_in", "source_out"), "source_in", "source_out")


@query(f"""
WITH e AS (SELECT l_orderkey, {_EDIT} AS k, l_partkey FROM lineitem)
SELECT l_orderkey, string_agg(printf('%03d  %-8s V     C        00:00:01:00 00:00:02:00', k, 'R' || l_partkey), chr(10) ORDER BY k) AS edl FROM e GROUP BY l_orderkey""")
def cmx_texts(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("at"), F.concat(F.lit("R"), F.col("l_partkey").cast("string")).alias("reel"), F.lit("00:00:01:00").alias("source_in"), F.lit("00:00:02:00").alias("source_out"))
    return render.edit_list_text(own, ["l_orderkey"], "at")


@query("""
SELECT p_partkey, 0 AS file_index, 'a b ' || p_partkey || '.ts' AS file, p_size + 0.5::DOUBLE AS duration, NULL::DOUBLE AS inpoint, 2.0::DOUBLE AS outpoint FROM part
UNION ALL SELECT p_partkey, 1, 'second.ts', NULL, 1.5, NULL FROM part""")
def concat_lists(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("# a list\r\n\r\nfile 'a b "), key, F.lit(".ts'\r\n  duration "), F.col("p_size").cast("string"), F.lit(".5\r\noutpoint 2.0\r\nfile second.ts\r\ninpoint 1.5\r\n"))
    return subtitles.parse_concat_list(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")


@query("""
SELECT p_partkey, 's3' AS scheme, 'bucket' || p_size AS bucket, 'dir/' || p_partkey || '.mp4' AS path, md5(p_name) AS trace_id, substr(md5(p_name), 1, 16) AS span_id, p_size % 2 = 1 AS sampled,
  ('0x' || substr(md5(p_name), 1, 2))::INTEGER AS r, ('0x' || substr(md5(p_name), 3, 2))::INTEGER AS g, ('0x' || substr(md5(p_name), 5, 2))::INTEGER AS b, 255 AS a,
  CASE p_size % 5 WHEN 0 THEN 'mp4' WHEN 1 THEN 'matroska' WHEN 2 THEN 'mpegts' WHEN 3 THEN 'webm' END AS container, gcd(p_size, 84)::BIGINT AS divisor, p_partkey::VARCHAR AS msn
FROM part""")
def option_texts(spark, sf_dir):
    size, key, digest = F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), F.md5(F.col("p_name").cast("binary"))
    own = table(spark, sf_dir, "part").select(
        "p_partkey",
        options.cloud_url(F.concat(F.lit("s3://bucket"), size, F.lit("/dir/"), key, F.lit(".mp4"))).alias("u"),
        options.trace_parent(F.concat(F.lit("00-"), digest, F.lit("-"), F.substring(digest, 1, 16), F.lit("-0"), (F.col("p_size") % 2).cast("string"))).alias("t"),
        options.color(F.concat(F.lit("#"), F.substring(digest, 1, 6))).alias("c"),
        options.container(F.get(numbered("mp4", "MKV", "m2ts", "webm", "xyz"), F.col("p_size") % 5)).alias("container"),
        options.gcd(F.col("p_size"), F.lit(84)).alias("divisor"),
        options.query_parameter(F.concat(F.lit("?_HLS_part=1&_HLS_msn="), key), "_HLS_msn").alias("msn"),
    )
    return own.select("p_partkey", "u.*", "t.*", "c.*", "container", "divisor", "msn")


@query("""
SELECT p_partkey, 'in' || p_partkey || '.mov' AS first_input, 2 AS n_inputs, 'out.mp4' AS output, CASE WHEN p_size % 2 = 0 THEN 'libx264' END AS video_codec, p_size % 2 = 1 AS copy_video, 'aac' AS audio_codec,
  p_size * 1000::BIGINT AS video_bitrate, 23.5::DOUBLE AS crf, 'slow' AS preset, 1280 AS width, 25.0::DOUBLE AS frame_rate, 'scale=640:-1,fps=30' AS video_filters, 90.0::DOUBLE AS start_time, NULL::DOUBLE AS duration, true AS no_audio, true AS overwrite
FROM part""")
def option_sets(spark, sf_dir):
    codec = F.when(F.col("p_size") % 2 == 0, "libx264").otherwise("copy")
    text = F.concat(F.lit("ffmpeg -y -ss 1:30 -i in"), F.col("p_partkey").cast("string"), F.lit(".mov -i second.wav -c:v "), codec, F.lit(" -b:v "), F.col("p_size").cast("string"), F.lit("k -crf 23.5 -preset slow -s hd720 -r 25 -vf scale=640:-1,fps=30 -c:a aac -an out.mp4"))
    own = table(spark, sf_dir, "part").select("p_partkey", options.option_set(text).alias("o"))
    names = "output video_codec copy_video audio_codec video_bitrate crf preset frame_rate video_filters start_time duration no_audio overwrite".split()
    return own.select("p_partkey", F.get("o.inputs", F.lit(0)).alias("first_input"), F.size("o.inputs").alias("n_inputs"), F.col("o.resolution.width").alias("width"), *[f"o.{n}" for n in names])


@query("""SELECT event_id, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS line FROM events""")
def json_export_rows(spark, sf_dir):
    return render.json_lines(events(spark, sf_dir).select("event_id", "user_id", "event_type"), "event_id")


@query("""
WITH v AS (SELECT o_custkey, o_orderkey, o_orderkey * 1000 AS bw, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders),
p AS (SELECT o_custkey, string_agg(printf('#EXT-X-STREAM-INF:BANDWIDTH=%d,%sRESOLUTION=1280x720,FRAME-RATE=%s,CODECS="avc1.640028"%s', bw, CASE WHEN o_orderkey % 2 = 0 THEN printf('AVERAGE-BANDWIDTH=%d,', o_orderkey * 900) ELSE '' END,
  '25.000', CASE WHEN o_orderkey % 3 = 0 THEN ',AUDIO="aac"' ELSE '' END) || chr(10) || 'v' || o_orderkey || '.m3u8', chr(10) ORDER BY bw DESC) AS variants,
  string_agg(printf('      <Representation id="%d" bandwidth="%d" codecs="avc1.640028" width="1280" height="720" frameRate="25"/>', k, bw) || chr(10), '' ORDER BY bw) AS reps, max(o_orderkey % 100) + 0.5::DOUBLE AS s FROM v GROUP BY o_custkey)
SELECT o_custkey, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-INDEPENDENT-SEGMENTS' || chr(10) || CASE WHEN o_custkey % 2 = 0 THEN '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="aac",NAME="Main",LANGUAGE="en",DEFAULT=YES,URI="a' || o_custkey || '.m3u8"' || chr(10) ELSE '' END || variants AS playlist,
  '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<MPD xmlns="urn:mpeg:dash:schema:mpd:2011"' || chr(10) || '     xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"' || chr(10)
  || '     xsi:schemaLocation="urn:mpeg:dash:schema:mpd:2011 DASH-MPD.xsd"' || chr(10) || '     type="static"' || chr(10) || '     profiles="urn:mpeg:dash:profile:isoff-on-demand:2011"' || chr(10) || '     minBufferTime="PT2.0S"' || chr(10)
  || printf('     mediaPresentationDuration="PT%.3fS"', s) || chr(10) || '>' || chr(10) || printf('  <Period id="0" start="PT0.000S" duration="PT%.3fS">', s) || chr(10)
  || '    <AdaptationSet id="0" mimeType="video/mp4" codecs="avc1.640028" contentType="video" segmentAlignment="true">' || chr(10) || '      <SegmentTemplate timescale="90000" duration="540000" startNumber="1"' || chr(10)
  || '                        initialization="init_$RepresentationID$.mp4" media="segment_$RepresentationID$_$Number$.m4s"/>' || chr(10) || reps || '    </AdaptationSet>' || chr(10) || '  </Period>' || chr(10) || '</MPD>' || chr(10) AS manifest
FROM p""")
def master_playlists(spark, sf_dir):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    own = table(spark, sf_dir, "orders").select(
        "o_custkey", (key * 1000).alias("bandwidth"), F.when(key % 2 == 0, key * 900).alias("average_bandwidth"), F.lit(1280).alias("width"), F.lit(720).alias("height"), F.concat(F.lit("v"), key.cast("string"), F.lit(".m3u8")).alias("uri"),
        F.lit("avc1.640028").alias("codecs"), F.when(key % 3 == 0, "aac").alias("audio_group"), (key % 100 + 0.5).alias("seconds"),
    )
    tracks = table(spark, sf_dir, "orders").where(customer % 2 == 0).groupBy("o_custkey").agg(F.lit("aac").alias("group_id"))
    audio = tracks.select("o_custkey", "group_id", F.lit("Main").alias("name"), F.lit("en").alias("language"), F.lit(True).alias("is_default"), F.lit(False).alias("autoselect"), F.concat(F.lit("a"), customer.cast("string"), F.lit(".m3u8")).alias("uri"))
    playlists = render.master_playlist(own.withColumn("frame_rate", F.lit(25.0)), ["o_custkey"], audio)
    return playlists.join(render.manifest_xml(own.withColumn("frame_rate", F.lit("25")), ["o_custkey"], "seconds"), "o_custkey")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS q FROM orders)
SELECT o_custkey, o_orderkey, 3 AS skipped FROM s WHERE q >= 3""")
def delta_playlists(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lit(4.0).alias("duration"))
    return render.delta_playlist(render.segments(own, ["o_custkey"], "o_orderkey", "duration"), ["o_custkey"], 3).select("o_custkey", "o_orderkey", "skipped")


# Scores and timecodes


@query("""
WITH e AS (SELECT event_id, value, event_id % 4 AS k, (event_id % 4000)::INTEGER AS w, (event_id % 4000 * 9 // 16)::INTEGER AS h, event_id % 100 AS s, event_id * 7 % 100 AS t FROM events),
q AS (SELECT *, CASE k WHEN 0 THEN value WHEN 1 THEN value / 200 * 100 WHEN 2 THEN least(greatest((value - 20) / 30 * 100, 0), 100) ELSE 0 END AS score FROM e)
SELECT event_id, round(score, 6) AS score, CASE WHEN score >= 93 THEN 'Excellent' WHEN score >= 80 THEN 'Good' WHEN score >= 60 THEN 'Fair' ELSE 'Poor' END AS rating,
  CASE WHEN w * h >= 8294400 THEN 'Uhd4K' WHEN w * h >= 2073600 THEN 'Fhd1080P' WHEN w * h >= 921600 THEN 'Hd720P' WHEN w * h >= 409920 THEN 'Sd480P' ELSE 'Low' END AS category,
  CASE WHEN value > 70 THEN 'Slow' WHEN value > 40 THEN 'Medium' ELSE 'Fast' END AS preset,
  CASE WHEN s < 20 AND t < 20 THEN 'Animation' WHEN s < 40 AND t < 15 THEN 'TalkingHead' WHEN t > 60 THEN 'Sports' WHEN s > 70 THEN 'Nature' WHEN s > 50 AND t > 40 THEN 'Gaming' WHEN s > 40 THEN 'Film' ELSE 'Generic' END AS content,
  CASE k WHEN 0 THEN 2 WHEN 1 THEN -2 WHEN 2 THEN -1 ELSE 0 END AS crf,
  CASE WHEN s / 100.0::DOUBLE < 0.25 THEN 'Simple' WHEN s / 100.0::DOUBLE < 0.5 THEN 'Moderate' WHEN s / 100.0::DOUBLE < 0.75 THEN 'Complex' ELSE 'Extreme' END AS profile
FROM q""")
def quality_scores(spark, sf_dir):
    k, v, s, t = F.col("event_id") % 4, F.col("value"), F.col("event_id") % 100, F.col("event_id") * 7 % 100
    score = scores.overall_quality(F.when(k == 2, v), F.when(k == 1, v / 200), F.when(k == 0, v))
    own = events(spark, sf_dir).withColumn("__score", score)
    width, height = (F.col("event_id") % 4000).cast("int"), F.call_function("div", F.col("event_id") % 4000 * 9, F.lit(16)).cast("int")
    return own.select(
        "event_id", r6("__score").alias("score"), scores.quality_rating(F.col("__score")).alias("rating"), scores.resolution_category(width, height).alias("category"), scores.preset(v).alias("preset"),
        scores.content_type(s, t).alias("content"), scores.crf_adjustment(F.get(numbered("Static", "Sports", "Graphics", "Unknown"), k.cast("int"))).alias("crf"), scores.profile_class(s / 100.0).alias("profile"),
    )


@query("""
WITH e AS (SELECT event_id, value, least(greatest(value / 100, 0), 1) AS x, [24.0, 24000 / 1001.0, 25.0, 30.0, 60.0, 12.5][event_id % 6 + 1]::DOUBLE AS s, [30.0, 24.0, 25.0, 50.0][event_id % 4 + 1]::DOUBLE AS t FROM events)
SELECT event_id, round(10000 * pow(greatest(pow(x, 32 / 2523.0::DOUBLE) - 3424 / 4096.0::DOUBLE, 0) / (2413 / 128.0::DOUBLE - 2392 / 128.0::DOUBLE * pow(x, 32 / 2523.0::DOUBLE)), 16384 / 2610.0::DOUBLE), 3) AS nits,
  CASE WHEN abs(s - t) < 0.001 THEN 'DropDuplicate' WHEN s BETWEEN 23.9 AND 24.1 AND t = 30 THEN 'Telecine' WHEN s = 30 AND t = 24 THEN 'InverseTelecine' WHEN (s = 24 AND t = 25) OR (s = 25 AND t = 24) THEN 'SpeedChange'
    WHEN s <> 12.5 THEN 'Blend' WHEN t / s NOT BETWEEN 0.67 AND 1.5 THEN 'MotionCompensated' ELSE 'Blend' END AS conversion,
  CASE WHEN x < 0.01 THEN 'Silence' ELSE ['Music', 'Mixed', 'Speech'][2 + sign((x > 0.05)::INTEGER + (value * 40 < 3000)::INTEGER - (x < 0.1)::INTEGER - (value * 40 > 1000)::INTEGER)::INTEGER] END AS audio
FROM e WHERE x > 0""")
def rates_and_transfer(spark, sf_dir):
    v, k = F.col("value"), F.col("event_id")
    x = F.least(F.greatest(v / 100, F.lit(0.0)), F.lit(1.0))
    rate = lambda values, n: F.get(F.array(*[F.lit(r) for r in values]), (k % n).cast("int"))
    source, target = rate((24.0, 24000 / 1001, 25.0, 30.0, 60.0, 12.5), 6), rate((30.0, 24.0, 25.0, 50.0), 4)
    own = events(spark, sf_dir).where(x > 0)
    return own.select("event_id", F.round(scores.pq_eotf(x), 3).alias("nits"), scores.suggested_conversion(source, target).alias("conversion"), scores.audio_type(x, x, v * 40).alias("audio"))


@query("""
WITH e AS (SELECT event_id, value, (event_id * 7) % 2160000 AS f FROM events),
m AS (SELECT *, f + event_id % 101 - 50 AS moved FROM e)
SELECT event_id, printf('%02d:%02d:%02d:%02d', (f // 90000) % 24, (f // 1500) % 60, (f // 25) % 60, f % 25) AS timecode, f AS back, round((f // 25) + (f % 25) / 25.0::DOUBLE, 6) AS seconds,
  CASE WHEN moved >= 0 THEN printf('%02d:%02d:%02d:%02d', (moved // 90000) % 24, (moved // 1500) % 60, (moved // 25) % 60, moved % 25) END AS moved,
  (f // 1500) % 60 % 10 <> 0 AND (f // 25) % 60 = 0 AND f % 25 < 2 AS dropped, 2 * ((event_id % 24) * 60 + event_id % 60 - ((event_id % 24) * 60 + event_id % 60) // 10) AS dropped_until,
  round(value * 25)::BIGINT AS frame, round(event_id / 25.0::DOUBLE, 6) AS time, trunc(value / (1 / 90000.0::DOUBLE))::BIGINT AS ticks, event_id * 1001 * 3 AS finest
FROM m""")
def timecode_fields(spark, sf_dir):
    f, k = F.col("f"), F.col("event_id")
    own = events(spark, sf_dir).withColumn("f", k * 7 % 2_160_000).withColumn("timecode", timebase.timecode(F.col("f"), 25))
    d = lambda n: F.call_function("div", f, F.lit(n))
    return own.select(
        "event_id", "timecode", timebase.timecode_to_frame(F.col("timecode"), 25).alias("back"), r6(timebase.timecode_to_seconds(F.col("timecode"), 25)).alias("seconds"),
        timebase.add_frames(F.col("timecode"), k % 101 - 50, 25).alias("moved"), timebase.is_dropped_frame(d(1500) % 60, d(25) % 60, f % 25, "29.97").alias("dropped"),
        timebase.frames_dropped_until(k % 24, k % 60, "29.97").alias("dropped_until"), timebase.frame_of(F.col("value"), 25.0).alias("frame"), r6(timebase.time_of(k, 25.0)).alias("time"),
        timebase.from_seconds(F.col("value"), 1, 90_000).alias("ticks"), timebase.comparable(k, 1001, 30_000, 1, 90_000).alias("finest"),
    )


# Filters, arrays, loudness


@query("""
WITH e AS (SELECT event_id, user_id, value, unnest(range((floor((event_id + 1) * 1.2::DOUBLE) - floor(event_id * 1.2::DOUBLE))::BIGINT))::INTEGER AS copy FROM events)
SELECT event_id, copy, greatest(user_id, 100) AS width, 50 AS height, 30.0::DOUBLE AS fps, round(event_id / 2.0::DOUBLE, 6) AS ts, 'yuv420p' AS format,
  round(least(greatest((value * 2 - 128) * 1.5 + 128 + 25.5, 0), 255), 6) AS first, round(least(greatest((value - 128) * 1.5 + 128 + 25.5, 0), 255), 6) AS second, round(value * 0.5, 6) AS sample FROM e""")
def filter_stages(spark, sf_dir):
    own = events(spark, sf_dir).select("event_id", F.col("event_id").alias("frame"), F.col("user_id").alias("stream"), F.col("user_id").alias("width"), F.lit(40).cast("long").alias("height"), F.lit(25.0).alias("fps"), F.col("event_id").cast("double").alias("ts"), F.array("value", F.col("value") * 2).alias("data"), F.array("value").alias("samples"))
    made = filters.apply(own, "pad=100:50, eq=brightness=0.1:contrast=1.5, vflip=1, volume=0.5, atempo=2, format=yuv420p, fps=30")
    return made.select("event_id", "copy", "width", F.col("height").cast("int").alias("height"), "fps", r6("ts").alias("ts"), "format", r6(F.get("data", F.lit(0))).alias("first"), r6(F.get("data", F.lit(1))).alias("second"), r6(F.get("samples", F.lit(0))).alias("sample"))


@query("SELECT event_id, round(value * 0.75 + (value + 8) * 0.25, 6) AS blended FROM events")
def overlay_graph(spark, sf_dir):
    base = events(spark, sf_dir).select("event_id", F.col("event_id").alias("frame"), F.array("value").alias("data"))
    top = events(spark, sf_dir).select(F.col("event_id").alias("frame"), F.array(F.col("value") + 8).alias("data"))
    made = filters.run_graph({"base": base, "top": top}, "[base][top]overlay=alpha=0.25[out]")["out"]
    return made.select("event_id", r6(F.get("data", F.lit(0))).alias("blended"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings), p AS (SELECT vec_id, a, list_reverse(a) AS b FROM e)
SELECT vec_id, round(list_dot_product(a, b) / len(a), 6) AS correlation, round(sqrt(list_dot_product(a, a) / len(a)), 6) AS rms, round(a[1] * 0.75 + b[1] * 0.25, 6) AS blended,
  round((a[2] * 0.25 + b[2] * 0.5) + a[2] * 0.25, 6) AS mixed, round(a[3] * 1.0, 6) AS reordered, round(a[1] * 0.5 + b[1] * 0.5, 6) AS down, round(a[4] * 2, 6) AS louder,
  round((abs(a[1] * 100 - b[1] * 100) / 255 + bit_count(xor(vec_id, vec_id * 3)) / 64.0::DOUBLE) / 2, 6) AS content, CASE WHEN greatest(abs(a[1]), abs(b[1])) > 0 THEN round(abs(abs(a[1]) - abs(b[1])) / greatest(abs(a[1]), abs(b[1])), 6) ELSE 0 END AS edges,
  round(list_sum(list_transform(range(1, len(a)), lambda i: CASE WHEN (a[i] >= 0) <> (a[i + 1] >= 0) THEN 1.0::DOUBLE ELSE 0 END)) / (len(a) - 1), 6) AS crossings
FROM p""")
def array_kernels(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a")).withColumn("b", F.reverse("a"))
    at = lambda c, i: F.get(c, F.lit(i))
    size = F.abs(at(a, 0)), F.abs(at(b, 0))
    made = own.select(
        "vec_id", arrays.correlate(a, b).alias("correlation"), arrays.rms(a).alias("rms"), at(arrays.blend(a, b, 0.25), 0).alias("blended"), at(arrays.blend_many(F.array(a, b, a), [1.0, 2.0, 1.0]), 1).alias("mixed"),
        at(arrays.reorder(a, [2, 0, 1]), 0).alias("reordered"), at(at(arrays.downmix(F.array(a, b), [[0.5, 0.5]]), 0), 0).alias("down"), at(arrays.gain(a, 6.020599913279624), 3).alias("louder"),
        arrays.content_difference(at(a, 0) * 100, at(b, 0) * 100, F.col("vec_id"), F.col("vec_id") * 3).alias("content"), arrays.edge_difference(*size).alias("edges"), arrays.zero_crossings(a).alias("crossings"),
    )
    return rounded(made, *[c for c in made.columns if c != "vec_id"])


@query("""
WITH c AS (SELECT event_id, value / 10 AS r, value / 20 AS g, value / 40 AS b FROM events),
p AS (SELECT event_id, 10 * log10(65025 / (r * r)) AS r, 10 * log10(65025 / (g * g)) AS g, 10 * log10(65025 / (b * b)) AS b FROM c WHERE r > 0)
SELECT event_id, round(10 * log10(65025 / ((65025 / pow(10, r / 10) * 6 + 65025 / pow(10, g / 10) + 65025 / pow(10, b / 10)) / 8)), 6) AS psnr FROM p""")
def psnr_weighted(spark, sf_dir):
    v = F.col("value")
    channels = [arrays.psnr((v / n) * (v / n)) for n in (10, 20, 40)]
    return rounded(events(spark, sf_dir).where(v > 0).select("event_id", arrays.weighted_psnr(channels, (6.0, 1.0, 1.0)).alias("psnr")), "psnr")


@query("SELECT event_id, round(least(-23 - (-value), 20, -1 - (value / 100 - 5)), 6) AS gain FROM events")
def loudness_gain(spark, sf_dir):
    own = events(spark, sf_dir).select("event_id", loudness.normalization_gain(-F.col("value"), F.col("value") / 100 - 5, -23.0, 20.0, -1.0).alias("gain"))
    return rounded(own, "gain")


def _k_weighting_sql() -> str:
    """Both filters as one fold of each user's samples; a state is [x1, x2, y1, y2, z1, z2, out]."""
    (p0, p1, p2, p3, p4), (q0, q1, q2, q3, q4) = loudness.biquads(48_000)
    first = f"({p0!r} * x + {p1!r} * a[1] + {p2!r} * a[2] - {p3!r} * a[3] - {p4!r} * a[4])"
    second = f"({q0!r} * {first} + {q1!r} * a[3] + {q2!r} * a[4] - {q3!r} * a[5] - {q4!r} * a[6])"
    return f"""
WITH l AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids, list(value / 200 ORDER BY event_id) AS xs FROM events GROUP BY user_id),
f AS (SELECT user_id, ids, list_reduce(list_transform(xs, lambda x: [x]), lambda s, v: list_concat(
  list_transform([[v[1], s[1], {first.replace('x +', 'v[1] +').replace('a[', 's[')}, s[3], {second.replace('x +', 'v[1] +').replace('a[', 's[')}, s[5]]], lambda r: r)[1], s[7:], [{second.replace('x +', 'v[1] +').replace('a[', 's[')}]),
  [0, 0, 0, 0, 0, 0]::DOUBLE[]) AS s FROM l)
SELECT user_id, unnest(ids) AS event_id, round(unnest(s[7:]), 6) AS weighted FROM f"""


@query(_k_weighting_sql())
def k_weighted_samples(spark, sf_dir):
    own = events(spark, sf_dir).select("user_id", "event_id", (F.col("value") / 200).alias("sample"))
    return rounded(loudness.k_weighted(own, U, "event_id", "sample", 48_000).select("user_id", "event_id", "weighted"), "weighted")


# Reads


@query("SELECT event_id, 'type' AS asked FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'job' FROM events WHERE user_id = 7")
def audit_entries(spark, sf_dir):
    own = events(spark, sf_dir)
    return reads.with_value(own, "event_type", "error").select("event_id", F.lit("type").alias("asked")).unionAll(reads.with_value(own, "user_id", 7).select("event_id", F.lit("job").alias("asked")))


@query("SELECT event_id, value FROM events WHERE event_id > 500")
def stream_updates(spark, sf_dir):
    return reads.updates_since(events(spark, sf_dir), "event_id", 500).select("event_id", "value")


@query(f"SELECT event_id, 'high' AS rule FROM (SELECT event_id, value, {_METRIC} AS metric FROM events) WHERE metric = 'vmaf' AND value > 150")
def critical_alerts(spark, sf_dir):
    return reads.with_value(_alerts(spark, sf_dir), "severity", "critical").select("event_id", "rule")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def recent_jobs(spark, sf_dir):
    return reads.newest_first(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey = 5 AND l_linestatus IN ('O')")
def worker_tasks(spark, sf_dir):
    return reads.tasks_of_worker(table(spark, sf_dir, "lineitem"), "l_suppkey", 5, "l_linestatus", ("O",)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
WITH w AS (SELECT s_suppkey, s_suppkey * 10 AS heard, CASE s_nationkey % 3 WHEN 0 THEN 'healthy' WHEN 1 THEN 'unhealthy' ELSE 'offline' END AS health FROM supplier)
SELECT s_suppkey, 'stale' AS asked FROM w WHERE heard < 500 AND health <> 'offline' UNION ALL SELECT s_suppkey, 'healthy' FROM w WHERE heard >= 500 AND health = 'healthy'""")
def worker_health(spark, sf_dir):
    health = F.get(numbered("healthy", "unhealthy", "offline"), F.col("s_nationkey") % 3)
    own = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 10).alias("last_heartbeat"), health.alias("health"))
    parts = (selection.stale_workers(own, F.lit(500)), "stale"), (selection.healthy_workers(own, F.lit(500)), "healthy")
    return reduce(lambda a, b: a.unionAll(b), [df.select("s_suppkey", F.lit(asked).alias("asked")) for df, asked in parts])


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber % 2 AS track, sum((l_quantity - l_discount) / (1 + l_tax)) AS d FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, round(max(d), 6) AS total_duration FROM t GROUP BY l_orderkey""")
def timeline_durations(spark, sf_dir):
    clips = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).alias("track"), reads.clip_duration(F.col("l_discount"), F.col("l_quantity"), 1 + F.col("l_tax")).alias("d"))
    return rounded(reads.timeline_duration(clips, ["l_orderkey"], "track", "d"), "total_duration")


@query(f"WITH {_CUES} SELECT conv_id, max(end_ms) AS duration FROM c GROUP BY conv_id")
def track_durations(spark, sf_dir):
    return reads.cues_end(_cues(spark, sf_dir), ["conv_id"], "end_ms")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber AS s, max(l_suppkey % 5) AS p FROM lineitem GROUP BY 1, 2), m AS (SELECT l_orderkey, min(s) + count(*) - 1 AS last_msn FROM s GROUP BY 1)
SELECT m.l_orderkey, m.last_msn::BIGINT AS last_msn, s.p AS last_part FROM m LEFT JOIN s ON s.l_orderkey = m.l_orderkey AND s.s = m.last_msn""")
def last_segment_parts(spark, sf_dir):
    return reads.last_parts(table(spark, sf_dir, "lineitem").withColumn("part", F.col("l_suppkey") % 5), ["l_orderkey"], "l_linenumber", "part")


@query("""
SELECT o_orderpriority, count(*) AS submitted, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed,
  round(coalesce(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 4) AS avg_seconds FROM orders GROUP BY o_orderpriority""")
def jobs_snapshot(spark, sf_dir):
    own = reads.jobs_snapshot(table(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P", "o_totalprice")
    return own.withColumn("avg_seconds", F.round("avg_seconds", 4))


@query("SELECT user_id, round(avg(sqrt(value * value + (event_id % 7) * (event_id % 7))), 6) AS magnitude FROM events GROUP BY user_id")
def motion_magnitude(spark, sf_dir):
    return rounded(reads.average_magnitude(events(spark, sf_dir).withColumn("dy", F.col("event_id") % 7), U, "value", "dy"), "magnitude")


@query("SELECT count(*) AS streams, sum(octet_length(encode(html)))::BIGINT AS bytes FROM pages")
def cache_totals(spark, sf_dir):
    return reads.cache_stats(table(spark, sf_dir, "pages"), F.octet_length("html"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
w AS (SELECT user_id, count(*) AS total_frames, sum(event_id)::BIGINT AS total_bytes, avg(value) AS avg_psnr FROM events GROUP BY user_id),
l AS (SELECT user_id, count(*) AS n, sum(event_id) AS b, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS s, avg(value) AS q, avg(value / 100) FILTER (event_type = 'view') AS avg_ssim FROM r WHERE k <= 20 GROUP BY user_id)
SELECT user_id, total_frames, total_bytes, round(avg_psnr, 6) AS avg_psnr, CASE WHEN s > 0 THEN round(n / s, 6) ELSE 0 END AS fps, CASE WHEN s > 0 THEN round(b * 8 / 1000 / s, 6) ELSE 0 END AS kbps, round(least(q, 100), 6) AS quality, round(avg_ssim, 6) AS avg_ssim
FROM w JOIN l USING (user_id)""")
def report_of_two_scopes(spark, sf_dir):
    own = events(spark, sf_dir).withColumn("ssim", F.when(F.col("event_type") == "view", F.col("value") / 100)).withColumn("time", F.col("value"))
    return rounded(metrics.mixed_report(own, U, ORDER, "ts", "event_id", "time", "value", "ssim", 20), "avg_psnr", "fps", "kbps", "quality", "avg_ssim")


@query("""
SELECT n_nationkey FROM nation WHERE CASE n_regionkey % 3 WHEN 0 THEN n_nationkey * 100 >= 800 WHEN 1 THEN n_nationkey IN (1, 2, 3, 18) AND n_nationkey % 2 = 0 ELSE n_nationkey % 2 = 0 END""")
def track_selection(spark, sf_dir):
    kind = F.get(numbered("video", "audio", "text"), F.col("n_regionkey") % 3)
    own = table(spark, sf_dir, "nation").select("n_nationkey", kind.alias("track_type"), F.col("n_nationkey").alias("track_id"), F.when(F.col("n_nationkey") % 2 == 0, "en").otherwise("de").alias("language"), (F.col("n_nationkey") * 100).alias("width"))
    return own.where(rules.track_selector({"audio": [1, 2, 3, 18]}, "en", 800)).select("n_nationkey")


@query("""
WITH e AS (SELECT user_id, event_id AS arrival, event_id + event_id * 7919 % 1500 AS "at" FROM events), m AS (SELECT *, max("at") OVER (PARTITION BY user_id ORDER BY arrival) AS latest FROM e),
t AS (SELECT user_id, latest, min(arrival) AS since FROM m GROUP BY user_id, latest), o AS (SELECT e.*, CASE WHEN t.since IS NOT NULL THEN greatest(t.since, e.arrival) END AS step FROM e ASOF LEFT JOIN t ON e.user_id = t.user_id AND e."at" + 2000 <= t.latest)
SELECT user_id, arrival, "at", row_number() OVER (PARTITION BY user_id ORDER BY step NULLS LAST, "at", arrival) - 1 AS released FROM o""")
def jitter_order(spark, sf_dir):
    """Events of a user by a time that is only nearly that of their arrival, out of a buffer 2,000 deep."""
    own = events(spark, sf_dir).select("user_id", F.col("event_id").alias("arrival"), (F.col("event_id") + F.pmod(F.col("event_id") * 7919, F.lit(1500))).alias("at"))
    return recurrences.jitter_buffered(own, U, "arrival", "at", 2000, 10_000)
