"""Option texts (bitrates, times, sizes, ratios, extensions, queries) to values; null if not valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named frame sizes; fixed values.
SIZES = {
    "sqcif": (128, 96),
    "qcif": (176, 144),
    "cif": (352, 288),
    "4cif": (704, 576),
    "qqvga": (160, 120),
    "qvga": (320, 240),
    "vga": (640, 480),
    "svga": (800, 600),
    "xga": (1024, 768),
    "sxga": (1280, 1024),
    "wxga": (1366, 768),
    "wsxga": (1600, 1024),
    "wuxga": (1920, 1200),
    "wqxga": (2560, 1600),
    "wqsxga": (3200, 2048),
    "wquxga": (3840, 2400),
    "hd480": (852, 480),
    "hd720": (1280, 720),
    "720p": (1280, 720),
    "hd1080": (1920, 1080),
    "1080p": (1920, 1080),
    "2k": (2048, 1080),
    "4k": (3840, 2160),
    "uhd": (3840, 2160),
    "2160p": (3840, 2160),
    "8k": (7680, 4320),
    "4320p": (7680, 4320),
    "ntsc": (720, 480),
    "pal": (720, 576),
}

#: Container of a file name's extension; fixed values.
CONTAINERS = {"mp4": "mp4", "m4v": "mp4", "m4a": "mp4", "mkv": "matroska", "webm": "webm", "ts": "mpegts", "mts": "mpegts", "m2ts": "mpegts", "flv": "flv", "mov": "mov"}

#: Aspect ratios to which a decimal within 0.01 is snapped; fixed values.
RATIOS = ((16, 9), (4, 3), (21, 9), (185, 100), (235, 100), (239, 100))


def _lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def bitrate(text: Column) -> Column:
    """Bits a second: a number with k, m or g for thousands, truncated."""
    pattern = r"^\s*(\d+(?:\.\d+)?)([kKmMgG]?)\s*$"
    number = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("double")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    return (number * F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)).cast("long")


def seconds(text: Column) -> Column:
    """S, M:S or H:M:S with decimals."""
    valid = text.rlike(r"^\s*\d+(\.\d+)?(:\d+(\.\d+)?){0,2}\s*$")
    parts = F.split(F.trim(text), ":")
    return F.when(valid, F.aggregate(parts, F.lit(0.0), lambda total, part: total * 60 + part.cast("double")))


def resolution(text: Column) -> Column:
    """struct(width, height) of a named size or WxH."""
    name = F.lower(F.trim(text))
    pattern = r"^(\d+)x(\d+)$"
    own = [F.nullif(F.regexp_extract(name, pattern, k), F.lit("")).cast("int") for k in (1, 2)]
    named = [F.element_at(_lookup({n: wh[k] for n, wh in SIZES.items()}), name) for k in (0, 1)]
    width, height = (F.coalesce(a, b) for a, b in zip(own, named, strict=True))
    return F.when((width > 0) & (height > 0), F.struct(width.alias("width"), height.alias("height")))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of whole numbers, by a bounded number of Euclid's steps."""
    steps = F.sequence(F.lit(1), F.lit(92))
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    done = F.aggregate(steps, start, lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(F.try_mod(s["a"], s["b"])).alias("b")))
    return done["a"]


def aspect_ratio(text: Column) -> Column:
    """'num:den' as it is; a decimal snapped to a known ratio, else in thousandths, reduced."""
    pattern = r"^\s*(\d+):(\d+)\s*$"
    num, den = (F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("long") for k in (1, 2))
    value = F.when(text.rlike(r"^\s*\d+(\.\d+)?\s*$"), F.trim(text).cast("double"))
    snapped = F.coalesce(*[F.when(F.abs(value - n / d) < 0.01, F.format_string("%d:%d", F.lit(n), F.lit(d))) for n, d in RATIOS])
    whole = F.round(value * 1000).cast("long")
    divisor = gcd(whole, F.lit(1000))
    reduced = F.format_string("%d:%d", F.call_function("div", whole, divisor), F.call_function("div", F.lit(1000).cast("long"), divisor))
    return F.when(den > 0, F.format_string("%d:%d", num, den)).when(value > 0, F.coalesce(snapped, reduced))


def container(extension: Column) -> Column:
    return F.element_at(_lookup(CONTAINERS), F.lower(extension))


def trace_parent(text: Column) -> Column:
    """struct(trace_id, span_id, sampled) of a version 00 traceparent."""
    pattern = r"^00-([0-9a-fA-F]{32})-([0-9a-fA-F]{16})-([0-9a-fA-F]{2})$"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("trace_id"), F.regexp_extract(text, pattern, 2).alias("span_id"), (F.conv(F.regexp_extract(text, pattern, 3), 16, 10).cast("int") % 2 == 1).alias("sampled")))


def query_parameter(text: Column, name: str) -> Column:
    """A parameter of a query string a=1&b=2."""
    return F.element_at(F.str_to_map(F.regexp_replace(text, r"^\?", ""), F.lit("&"), F.lit("=")), name)


def cloud_url(text: Column) -> Column:
    """struct(scheme, bucket, path) of an s3, gs or az address."""
    pattern = r"^(s3|gs|az)://([^/]+)/?(.*)$"
    return F.when(text.rlike(pattern), F.struct(*[F.regexp_extract(text, pattern, k).alias(n) for k, n in ((1, "scheme"), (2, "bucket"), (3, "path"))]))


def color(text: Column) -> Column:
    """struct(r, g, b, a) of #RGB, #RRGGBB or #RRGGBBAA."""
    digits = F.regexp_replace(text, "^#", "")
    long = F.when(F.length(digits) == 3, F.concat(*[F.repeat(F.substring(digits, k, 1), 2) for k in (1, 2, 3)], F.lit("FF"))).when(F.length(digits) == 6, F.concat(digits, F.lit("FF"))).when(F.length(digits) == 8, digits)
    part = lambda k: F.conv(F.substring(long, k, 2), 16, 10).cast("int")
    return F.when(digits.rlike("^[0-9a-fA-F]+$") & long.isNotNull(), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), part(7).alias("a")))


def _argument(text: Column, names: str) -> Column:
    """The word after an option of one of the names; null if it is not given."""
    return F.nullif(F.regexp_extract(text, rf"(?:^|\s)-(?:{names})\s+(\S+)", 1), F.lit(""))


def option_set(text: Column) -> Column:
    """struct of what a command line sets: inputs, output, codecs, rates, filters, times and flags.

    Words are divided by blanks; the output is the last word. A codec `copy` sets
    the copy flag and no codec. What is not given is null, false or empty.
    """
    video, audio = _argument(text, "c:v|vcodec|codec:v"), _argument(text, "c:a|acodec|codec:a")
    flag = lambda name: text.rlike(rf"(?:^|\s)-{name}(?:\s|$)")
    codec = lambda c: F.when(c != "copy", c)
    return F.struct(
        F.regexp_extract_all(text, F.lit(r"(?:^|\s)-i\s+(\S+)"), 1).alias("inputs"),
        F.element_at(F.split(F.trim(text), r"\s+"), -1).alias("output"),
        codec(video).alias("video_codec"), F.coalesce(video == "copy", F.lit(False)).alias("copy_video"), flag("vn").alias("no_video"),
        codec(audio).alias("audio_codec"), F.coalesce(audio == "copy", F.lit(False)).alias("copy_audio"), flag("an").alias("no_audio"),
        bitrate(_argument(text, "b:v|vb")).alias("video_bitrate"), bitrate(_argument(text, "b:a|ab")).alias("audio_bitrate"),
        _argument(text, "crf").cast("double").alias("crf"), _argument(text, "preset").alias("preset"),
        resolution(_argument(text, "s")).alias("resolution"), _argument(text, "r").cast("double").alias("frame_rate"), aspect_ratio(_argument(text, "aspect")).alias("aspect_ratio"),
        _argument(text, "vf|filter:v").alias("video_filters"), _argument(text, "af|filter:a").alias("audio_filters"), _argument(text, "filter_complex").alias("filter_complex"),
        seconds(_argument(text, "ss")).alias("start_time"), seconds(_argument(text, "t")).alias("duration"), seconds(_argument(text, "to")).alias("end_time"),
        flag("y").alias("overwrite"),
    )
