"""Rows to texts: playlists, manifests, exposition formats, CSV and JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def csv_line(columns: Sequence[tuple[str, str | None]]) -> Column:
    """Fields with their printf format (None: as text), '' for null, joined by commas."""
    return F.concat_ws(",", *[F.coalesce(F.format_string(fmt, F.col(c)) if fmt else F.col(c).cast("string"), F.lit("")) for c, fmt in columns])


def dashboard_csv(df: DataFrame) -> DataFrame:
    """frame, psnr and vmaf with 2 places, ssim with 4, bitrate with none."""
    null_safe = lambda c, fmt: F.when(F.col(c).isNotNull(), F.format_string(fmt, F.col(c))).otherwise("")
    return df.select("frame", F.concat_ws(",", F.col("frame").cast("string"), null_safe("psnr", "%.2f"), null_safe("ssim", "%.4f"), null_safe("vmaf", "%.2f"), null_safe("bitrate", "%.0f")).alias("line"))


def json_lines(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("line"))


def labels_text(labels: Column) -> Column:
    """{a="1",b="2"} in the order of the names, values escaped; '' for none."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    parts = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    return F.when(F.size(parts) > 0, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise("")


def sample_text(name: str, labels: Column, value: Column) -> Column:
    return F.concat(F.lit(name), labels_text(labels), F.lit(" "), value.cast("string"))


def histogram_text(df: DataFrame, name: str, by: Sequence[str]) -> DataFrame:
    """Exposition lines of histogram(): a bucket row each, with _sum and _count once a group."""
    own = F.create_map(*[x for c in by for x in (F.lit(c), F.col(c).cast("string"))]) if by else F.create_map().cast("map<string,string>")
    le = F.coalesce(F.col("le").cast("string"), F.lit("+Inf"))
    bucket = F.struct(sample_text(f"{name}_bucket", F.map_concat(own, F.create_map(F.lit("le"), le)), F.col("cumulative")).alias("line"))
    rest = [F.struct(F.when(F.col("le").isNull(), sample_text(f"{name}_{part}", own, F.col(part))).alias("line")) for part in ("sum", "count")]
    return df.select(F.explode(F.array(bucket, *rest)).alias("r")).select("r.line").where(F.col("line").isNotNull())


def segments(df: DataFrame, by: Sequence[str], order: str, duration: str, name: str = "segment", extension: str = "ts") -> DataFrame:
    """Sequence number, start and file name of each segment of a rendition."""
    ordered = W.partitionBy(*by).orderBy(order)
    own = df.withColumn("sequence", F.row_number().over(ordered) - 1)
    start = F.coalesce(F.sum(duration).over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return own.withColumn("start_time", start).withColumn("uri", F.format_string(f"{name}_%05d.{extension}", F.col("sequence")))


def media_playlist(df: DataFrame, by: Sequence[str], ended: bool = True, kind: str | None = None, part_target: float | None = None, date: str | None = None, init: str | None = None) -> DataFrame:
    """M3U8 text of each rendition of segments(): its rows become one text.

    kind: VOD or EVENT; part_target: seconds of a partial segment; date: a column
    with the rendition's start; init: the path of its initialisation segment.
    """
    rows = F.array_sort(F.collect_list(F.struct("sequence", "duration", "uri")))
    own = df.groupBy(*by).agg(rows.alias("__s"), F.ceil(F.max("duration")).alias("__t"), F.min("sequence").alias("__m"), *([F.min(date).alias("__d")] if date else []))
    lines = [F.lit("#EXTM3U"), F.lit("#EXT-X-VERSION:7"), F.format_string("#EXT-X-TARGETDURATION:%d", F.col("__t")), F.format_string("#EXT-X-MEDIA-SEQUENCE:%d", F.col("__m"))]
    lines += [F.lit(f"#EXT-X-PART-INF:PART-TARGET={part_target:.6f}")] if part_target is not None else []
    lines += [F.lit(f"#EXT-X-PLAYLIST-TYPE:{kind}")] if kind else []
    lines += [F.concat(F.lit("#EXT-X-PROGRAM-DATE-TIME:"), F.date_format("__d", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))] if date else []
    lines += [F.lit(f'#EXT-X-MAP:URI="{init}"')] if init else []
    parts = F.transform("__s", lambda s: F.concat(F.format_string("#EXTINF:%.6f,\n", s["duration"]), s["uri"]))
    end = F.array(F.lit("#EXT-X-ENDLIST")) if ended else F.array().cast("array<string>")
    return own.select(*by, F.array_join(F.concat(F.array(*lines), parts, end), "\n").alias("playlist"))


def delta_playlist(df: DataFrame, by: Sequence[str], skip: int) -> DataFrame:
    """Segments after the first `skip` of each rendition, with how many were skipped."""
    low = F.min("sequence").over(W.partitionBy(*by))
    return df.withColumn("skipped", F.lit(skip)).withColumn("__low", low).where(F.col("sequence") >= F.col("__low") + skip).drop("__low")


def _attributes(*parts: Column) -> Column:
    """Attributes joined by commas, null ones left out."""
    return F.concat_ws(",", *parts)


def master_playlist(df: DataFrame, by: Sequence[str], audio: DataFrame | None = None) -> DataFrame:
    """Variants of each title by falling bandwidth, after the tracks of its audio groups.

    df: bandwidth, width, height, uri and, as far as there, average_bandwidth,
    frame_rate, codecs and audio_group; audio: group_id, name, uri and, as far as
    there, language, is_default and autoselect, by group and name. Null, empty and
    zero attributes are left out.
    """
    have = lambda frame, names: [n for n in names if n in frame.columns]
    rows = F.sort_array(F.collect_list(F.struct("bandwidth", "width", "height", "uri", *have(df, ("average_bandwidth", "frame_rate", "codecs", "audio_group")))), asc=False)
    quoted = lambda name, c: F.when(c != "", F.concat(F.lit(f'{name}="'), c, F.lit('"')))

    def variant(v: Column) -> Column:
        parts = [F.format_string("BANDWIDTH=%d", v["bandwidth"])]
        optional = {
            "average_bandwidth": lambda c: F.when(c.isNotNull(), F.format_string("AVERAGE-BANDWIDTH=%d", c)), "frame_rate": lambda c: F.when(c > 0, F.format_string("FRAME-RATE=%.3f", c)),
            "codecs": lambda c: quoted("CODECS", c), "audio_group": lambda c: quoted("AUDIO", c),
        }
        own = {n: make(v[n]) for n, make in optional.items() if n in df.columns}
        size = F.when(v["width"].isNotNull() & v["height"].isNotNull(), F.format_string("RESOLUTION=%dx%d", v["width"], v["height"]))
        parts += [own.pop("average_bandwidth")] if "average_bandwidth" in own else []
        return F.concat(F.lit("#EXT-X-STREAM-INF:"), _attributes(*parts, size, *own.values()), F.lit("\n"), v["uri"])

    own = df.groupBy(*by).agg(rows.alias("__v"))
    lines = F.transform("__v", variant)
    if audio is not None:
        fields = have(audio, ("language", "is_default", "autoselect"))
        flag = lambda name, c: F.when(c, F.lit(f"{name}=YES"))

        def track(t: Column) -> Column:
            extra = {"language": lambda c: quoted("LANGUAGE", c), "is_default": lambda c: flag("DEFAULT", c), "autoselect": lambda c: flag("AUTOSELECT", c)}
            return F.concat(F.lit("#EXT-X-MEDIA:"), _attributes(F.lit("TYPE=AUDIO"), quoted("GROUP-ID", t["group_id"]), quoted("NAME", t["name"]), *[extra[n](t[n]) for n in fields], quoted("URI", t["uri"])))

        tracks = audio.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("group_id", "name", "uri", *fields))).alias("__a"))
        own = own.join(tracks, list(by), "left")
        lines = F.concat(F.coalesce(F.transform("__a", track), F.array().cast("array<string>")), lines)
    head = F.array(F.lit("#EXTM3U"), F.lit("#EXT-X-VERSION:7"), F.lit("#EXT-X-INDEPENDENT-SEGMENTS"))
    return own.select(*by, F.array_join(F.concat(head, lines), "\n").alias("playlist"))


#: Names of the manifest's schema, its profile and its attributes; fixed values.
MANIFEST_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<MPD xmlns="urn:mpeg:dash:schema:mpd:2011"\n     xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"\n'
    '     xsi:schemaLocation="urn:mpeg:dash:schema:mpd:2011 DASH-MPD.xsd"\n     type="static"\n     profiles="urn:mpeg:dash:profile:isoff-on-demand:2011"\n'
)


def manifest_xml(df: DataFrame, by: Sequence[str], seconds: str, mime: str = "video/mp4", timescale: int = 90_000, segment: float = 6.0, buffer: float = 2.0) -> DataFrame:
    """An on-demand manifest of each title: one period, one set, representations by bandwidth.

    df: bandwidth, width, height, codecs, frame_rate (text) and the title's length
    in the column `seconds`, whose greatest value counts. The set has the codecs of
    its first representation and a template of numbered segments.
    """
    rows = F.array_sort(F.collect_list(F.struct("bandwidth", "width", "height", "codecs", "frame_rate")))
    own = df.groupBy(*by).agg(rows.alias("__v"), F.max(seconds).cast("double").alias("__d"))
    tag = lambda v, i: F.format_string('      <Representation id="%d" bandwidth="%d" codecs="%s" width="%d" height="%d" frameRate="%s"/>\n', i, v["bandwidth"], v["codecs"], v["width"], v["height"], v["frame_rate"])
    template = (
        f'      <SegmentTemplate timescale="{timescale}" duration="{round(segment * timescale)}" startNumber="1"\n'
        '                        initialization="init_$RepresentationID$.mp4" media="segment_$RepresentationID$_$Number$.m4s"/>\n'
    )
    parts = (
        F.format_string(f'{MANIFEST_HEAD}     minBufferTime="PT{buffer:.1f}S"\n     mediaPresentationDuration="PT%.3fS"\n>\n  <Period id="0" start="PT0.000S" duration="PT%.3fS">\n', F.col("__d"), F.col("__d")),
        F.format_string(f'    <AdaptationSet id="0" mimeType="{mime}" codecs="%s" contentType="{mime.partition("/")[0]}" segmentAlignment="true">\n', F.get("__v", F.lit(0))["codecs"]),
        F.lit(template), F.array_join(F.transform("__v", tag), ""), F.lit("    </AdaptationSet>\n  </Period>\n</MPD>\n"),
    )
    return own.select(*by, F.concat(*parts).alias("manifest"))


def write_segments(df: DataFrame, folder: str, by: Sequence[str], mode: str = "error") -> None:
    """segments() as Parquet, a folder for each rendition; the shuffle before keeps files few."""
    df.repartition(*by).write.partitionBy(*by).mode(mode).parquet(folder)


def report_lines(results: DataFrame, profile: str, test: str, status: str, millis: str) -> DataFrame:
    """(section, profile, place, line): a test report as lines, to be read in this order.

    Section 0 is the summary, 1 the counts of each profile, 2 one line a test. The
    summary is one row of counts; tests are never gathered. A null profile is ''.
    """
    own = results.withColumn("__p", F.coalesce(F.col(profile).cast("string"), F.lit("")))
    is_ = lambda name: F.count_if(F.col(status) == name)
    counts = [F.count("*").alias("total"), is_("passed").alias("passed"), is_("failed").alias("failed"), is_("skipped").alias("skipped"), is_("error").alias("errors")]
    rate = F.bround(F.when(F.col("total") > 0, F.col("passed") / F.col("total") * 100).otherwise(0.0), 1)  # halves to even, which formatting would round up
    line = lambda text, *c: F.format_string(text, *[F.col(x) if isinstance(x, str) else x for x in c])
    whole = own.agg(*counts, F.coalesce(F.sum(millis), F.lit(0)).cast("long").alias("millis"))
    heads = [line("Total: %d", "total"), line("Passed: %d (%.1f%%)", "passed", rate), line("Failed: %d", "failed"), line("Skipped: %d", "skipped"), line("Errors: %d", "errors"), line("Duration: %dms", "millis")]
    summary = whole.select(F.lit(0).alias("section"), F.lit("").alias("profile"), F.posexplode(F.array(*heads)).alias("place", "line")).withColumn("place", F.col("place").cast("string"))
    groups = own.groupBy("__p").agg(*counts).select(F.lit(1), F.col("__p"), F.lit(""), line("%s: %d of %d passed (%.1f%%), %d failed", "__p", "passed", "total", rate, "failed"))
    mark = F.when(F.col(status) == "passed", "[PASS]").when(F.col(status) == "failed", "[FAIL]").when(F.col(status) == "skipped", "[SKIP]").otherwise("[ERR]")
    tests = own.select(F.lit(2), F.col("__p"), F.col(test).cast("string"), F.concat(mark, F.lit(" "), F.coalesce(F.col(test).cast("string"), F.lit("")), line(" %dms", millis)))
    return summary.unionAll(groups).unionAll(tests)


def dashboard_page(frames: DataFrame, summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, place, line): a page for each stream as lines of HTML, to be read by place.

    summary: total_frames and avg_, min_ and max_ of psnr and ssim, avg_vmaf; frames:
    frame, psnr, ssim and vmaf. Cards come first (places below 0), then a row of the
    table for each frame (its number), then the end (a null place, to be read last).
    """
    card = lambda name, text, *c: F.concat(F.lit(f'<div class="card"><b>{name}</b> '), F.format_string(text, *[F.col(x) for x in c]), F.lit("</div>"))
    cards = [
        F.lit("<!DOCTYPE html><html><head><title>Quality</title></head><body>"), card("Frames", "%d", "total_frames"), card("Avg PSNR", "%.2f dB", "avg_psnr"), card("Avg SSIM", "%.4f", "avg_ssim"),
        card("Avg VMAF", "%.1f", "avg_vmaf"), card("PSNR", "%.1f to %.1f dB", "min_psnr", "max_psnr"), card("SSIM", "%.4f to %.4f", "min_ssim", "max_ssim"),
        F.lit("<table><tr><th>Frame</th><th>PSNR</th><th>SSIM</th><th>VMAF</th></tr>"),
    ]
    head = summary.select(*by, F.posexplode(F.array(*cards)).alias("place", "line")).withColumn("place", F.col("place").cast("long") - len(cards))
    cell = lambda c, text: F.concat(F.lit("<td>"), F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(text, F.col(c))), F.lit("")), F.lit("</td>"))
    rows = frames.select(*by, F.col("frame").cast("long"), F.concat(F.lit("<tr>"), cell("frame", "%d"), cell("psnr", "%.2f"), cell("ssim", "%.4f"), cell("vmaf", "%.2f"), F.lit("</tr>")))
    end = summary.select(*by, F.lit(None).cast("long"), F.lit("</table></body></html>"))
    return head.unionAll(rows).unionAll(end)


def edit_list_text(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """CMX-like lines of each title's edits, numbered from 1."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), "reel", "source_in", "source_out")))
    lines = F.transform("__e", lambda e, i: F.format_string("%03d  %-8s V     C        %s %s", i + 1, e["reel"], e["source_in"], e["source_out"]))
    return df.groupBy(*by).agg(rows.alias("__e")).select(*by, F.array_join(lines, "\n").alias("edl"))
