"""Subtitle, edit-list and concat-list texts to rows, and cues back to text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.timebase import format_srt, format_vtt, parse_ass, parse_srt, parse_vtt, timecode_to_seconds


def detect_format(text: Column) -> Column:
    """vtt, ass, ssa or srt; srt where nothing tells."""
    body = F.regexp_replace(text, r"^[\ufeff\s]+", "")
    script = body.contains("[Script Info]")
    old = body.contains("v4.00") | body.contains("V4 Styles")
    return F.when(body.startswith("WEBVTT"), "vtt").when(script & (body.contains("v4.00+") | body.contains("V4+ Styles")), "ass").when(script & old, "ssa").when(script, "ass").otherwise("srt")


def _blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, lines): runs of lines between blank ones, in order."""
    clean = F.regexp_replace(F.col(text), "\r\n?", "\n")
    blocks = F.split(clean, r"\n[ \t]*\n+")
    return df.select(key, F.posexplode(blocks).alias("block", "body")).select(key, "block", F.split(F.regexp_replace("body", r"^\n+|\n+$", ""), "\n").alias("lines"))


def _cues(blocks: DataFrame, key: str, parse) -> DataFrame:
    """Cues of blocks whose first or second line has an arrow.

    A cue is made in a generator, so that conditions on its times don't make
    Spark compute them, and the lines behind them, again for each condition.
    """
    at = F.when(F.get("lines", F.lit(0)).contains("-->"), 0).when(F.get("lines", F.lit(1)).contains("-->"), 1)
    placed = blocks.select(key, "block", F.explode(F.array(F.struct(F.col("lines"), at.alias("at")))).alias("b")).where(F.col("b.at").isNotNull())
    times = F.split(F.get("b.lines", F.col("b.at")), "-->")
    start, end = parse(F.trim(F.get(times, F.lit(0)))), parse(F.get(F.split(F.trim(F.get(times, F.lit(1))), r"\s+"), F.lit(0)))
    text = F.array_join(F.slice("b.lines", F.col("b.at") + 2, F.size("b.lines")), "\n")
    cue = F.struct(start.alias("start_ms"), end.alias("end_ms"), text.alias("text"))
    return placed.select(key, "block", F.explode(F.array(cue)).alias("c")).select(key, "block", "c.*")


def parse_srt_cues(df: DataFrame, key: str, text: str, strict: bool = False) -> DataFrame:
    """(key, block, start_ms, end_ms, text). strict: a bad time line is an error, else the cue is left out."""
    cues = _cues(_blocks(df, key, text), key, parse_srt)
    bad = F.col("start_ms").isNull() | F.col("end_ms").isNull()
    if strict:
        return cues.withColumn("start_ms", F.when(bad, F.raise_error(F.concat(F.lit("bad time line in block "), F.col("block").cast("string"))).cast("long")).otherwise(F.col("start_ms")))
    return cues.where(~bad)


def parse_vtt_cues(df: DataFrame, key: str, text: str) -> DataFrame:
    """Like parse_srt_cues, of texts with a WEBVTT header; notes, styles and bad cues are left out."""
    blocks = _blocks(df.where(F.col(text).startswith("WEBVTT")), key, text)
    real = blocks.where(~F.get("lines", F.lit(0)).rlike(r"^(WEBVTT|NOTE|STYLE|REGION)"))
    return _cues(real, key, parse_vtt).where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())


def parse_ass_cues(df: DataFrame, key: str, text: str) -> DataFrame:
    """Cues of the Dialogue lines: layer, start, end, style and text without override codes."""
    lines = df.select(key, F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")).alias("block", "line"))
    fields = F.split(F.regexp_replace("line", r"^Dialogue:\s*", ""), ",", 10)
    own = lines.where(F.col("line").startswith("Dialogue:")).withColumn("__f", fields).where(F.size("__f") == 10)
    body = F.regexp_replace(F.regexp_replace(F.get("__f", F.lit(9)), r"\{[^}]*\}", ""), r"\\[Nn]", "\n")
    return own.select(key, "block", parse_ass(F.get("__f", F.lit(1))).alias("start_ms"), parse_ass(F.get("__f", F.lit(2))).alias("end_ms"), body.alias("text"), F.get("__f", F.lit(3)).alias("style"))


def srt_text(cues: DataFrame, key: str, order: str) -> DataFrame:
    """(key, srt): the cues of each document as one text, numbered from 1.

    A document's cues are gathered in one row, which is what the text is.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), "start_ms", "end_ms", "text")))
    own = cues.groupBy(key).agg(rows.alias("__c"))
    parts = F.transform("__c", lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), format_srt(c["start_ms"]), F.lit(" --> "), format_srt(c["end_ms"]), F.lit("\n"), c["text"], F.lit("\n")))
    return own.select(key, F.array_join(parts, "\n").alias("srt"))


def vtt_text(cues: DataFrame, key: str, order: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), "start_ms", "end_ms", "text")))
    own = cues.groupBy(key).agg(rows.alias("__c"))
    parts = F.transform("__c", lambda c: F.concat(format_vtt(c["start_ms"]), F.lit(" --> "), format_vtt(c["end_ms"]), F.lit("\n"), c["text"], F.lit("\n")))
    return own.select(key, F.concat(F.lit("WEBVTT\n\n"), F.array_join(parts, "\n")).alias("vtt"))


def parse_edl_csv(df: DataFrame, key: str, text: str) -> DataFrame:
    """Edits of a CSV whose header names a source; at least 5 fields, quotes trimmed, no quoted commas."""
    lines = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")
    rows = df.where(F.lower(F.get(lines, F.lit(0))).contains("source")).select(key, F.posexplode(lines).alias("line_no", "line")).where((F.col("line_no") > 0) & (F.trim("line") != ""))
    fields = F.transform(F.split("line", ","), lambda f: F.regexp_replace(F.trim(f), r'^"|"$', ""))
    own = rows.withColumn("__f", fields).where(F.size("__f") >= 5)
    return own.select(key, "line_no", *[F.get("__f", F.lit(i)).alias(n) for i, n in enumerate(("source", "source_in", "source_out", "record_in", "record_out"))])


#: number, reel, track, transition, source in and out, record in and out.
CMX_EVENT = r"^(\d{3,6})\s+(\S+)\s+(\S+)\s+(C|D|W\d*|K\S*)(?:\s+\d+)?\s+(\d\d:\d\d:\d\d[:;]\d\d)\s+(\d\d:\d\d:\d\d[:;]\d\d)\s+(\d\d:\d\d:\d\d[:;]\d\d)\s+(\d\d:\d\d:\d\d[:;]\d\d)"


def parse_cmx3600(df: DataFrame, key: str, text: str, fps: float) -> DataFrame:
    """Events of a CMX 3600 edit list, times in seconds."""
    lines = df.select(key, F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")).alias("line_no", "line")).where(F.col("line").rlike(CMX_EVENT))
    part = lambda k: F.regexp_extract("line", CMX_EVENT, k)
    return lines.select(key, part(1).cast("int").alias("event"), part(2).alias("reel"), part(3).alias("track"), part(4).alias("transition"), *[timecode_to_seconds(part(k), fps).alias(n) for k, n in ((5, "source_in"), (6, "source_out"), (7, "record_in"), (8, "record_out"))])


def parse_concat_list(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, file_index, file, duration, inpoint, outpoint) of a list of `file` lines with their options."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n"), lambda line: F.trim(line)), lambda line: (line != "") & ~line.startswith("#"))
    files = F.filter(F.split(F.array_join(lines, "\n"), r"(?m)^(?=file\s)"), lambda part: part.startswith("file"))
    rows = df.select(key, F.posexplode(files).alias("file_index", "part"))
    option = lambda name: F.nullif(F.regexp_extract("part", rf"(?m)^{name}\s+([0-9.]+)", 1), F.lit("")).cast("double")
    path = F.regexp_replace(F.regexp_extract("part", r"^file\s+(.*)", 1), r"^'|'$", "")
    return rows.select(key, "file_index", path.alias("file"), *[option(n).alias(n) for n in ("duration", "inpoint", "outpoint")])


def shift(cues: DataFrame, ms: int) -> DataFrame:
    """Both times moved, not below 0."""
    return cues.withColumns({c: F.greatest(F.col(c) + ms, F.lit(0).cast("long")) for c in ("start_ms", "end_ms")})


def stretch(cues: DataFrame, factor: float) -> DataFrame:
    return cues.withColumns({c: (F.col(c) * factor).cast("long") for c in ("start_ms", "end_ms")})


def snapped(cues: DataFrame, fps: float) -> DataFrame:
    """Start down and end up to whole frames of floor(1000 / fps) ms."""
    frame = int(1000 // fps)
    return cues.withColumns({"start_ms": (F.floor(F.col("start_ms") / frame) * frame).cast("long"), "end_ms": (F.ceil(F.col("end_ms") / frame) * frame).cast("long")})


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df
