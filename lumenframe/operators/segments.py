"""Tumbling segments, rate conversion and concatenation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tumbling(df: DataFrame, duration: str, size: float) -> DataFrame:
    """ceil(duration / size) segments of each row: index, start and end; size is 1 second at least.

    Rows without a positive duration have none.
    """
    size = max(float(size), 1.0)
    n = F.ceil(F.col(duration) / size).cast("int")
    rows = df.where(F.col(duration) > 0).withColumn("segment_index", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("segment_index") * size
    return rows.withColumn("segment_start", start).withColumn("segment_end", F.least(start + size, F.col(duration)))


def windowed(df: DataFrame, ts: str, seconds: int, by: Sequence[str], value: str) -> DataFrame:
    """Counts and sums of `seconds` long windows of event time; works on streams too."""
    own = df.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return own.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def drop_duplicate(df: DataFrame, by: Sequence[str], order: Sequence[str], ratio: float) -> DataFrame:
    """floor(k r) - floor((k - 1) r) copies of the k-th row of each stream, k from 1; copy counts from 0."""
    k = F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("double")
    copies = (F.floor(k * F.lit(ratio)) - F.floor((k - 1) * F.lit(ratio))).cast("int")
    return df.withColumn("__n", copies).where(F.col("__n") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")


def blended(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, ratio: float) -> DataFrame:
    """Rows at the output times of a rate `ratio` times as high, between the row before and this one.

    Output j, from 1, stands at j / ratio input rows; the first row gives none.
    """
    ordered = W.partitionBy(*by).orderBy(*order)
    own = df.withColumn("__k", F.row_number().over(ordered) - 1).withColumn("__prev", F.coalesce(F.lag(value).over(ordered), F.col(value)))
    first, last = F.floor((F.col("__k") - 1) * F.lit(ratio)) + 1, F.floor(F.col("__k") * F.lit(ratio))
    rows = own.where(F.col("__k") > 0).withColumn("__first", first).withColumn("__last", last).where(F.col("__last") >= F.col("__first"))
    rows = rows.withColumn("output", F.explode(F.sequence("__first", "__last")))
    share = F.least(F.greatest(F.col("output") / F.lit(ratio) - (F.col("__k") - 1), F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("blended", F.col("__prev") * (1 - share) + F.col(value) * share).drop("__k", "__prev", "__first", "__last")


def telecine(df: DataFrame, by: Sequence[str], order: Sequence[str], pattern: Sequence[int] = (2, 3, 2, 3)) -> DataFrame:
    """Each row as many fields as its place in the pulldown pattern says."""
    place = F.pmod(F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1, F.lit(len(pattern)))
    fields = F.element_at(F.array(*[F.lit(p) for p in pattern]), place + 1)
    return df.withColumn("__n", fields).withColumn("field", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")


#: Pulldown patterns and their rates, film and video; fixed values.
PULLDOWN_RATES = {"2:2": ("24000/1001", "48000/1001"), "none": ("24/1", "24/1")}


def telecine_pattern(df: DataFrame, by: Sequence[str], order: Sequence[str], difference: str, threshold: float = 0.02) -> DataFrame:
    """The pulldown pattern of each stream's first ten frames, its confidence, rates and phase.

    difference: of a frame to the one before, 0 to 1. Of each five frames in a row
    the four differences should lie below the threshold at the first and third
    place alone; the first five frames with three places right or more decide, and
    the share that is right is the confidence. Over four differences 3:2 looks no
    different, and 2:2 is what they are called. Null differences are not below.
    Streams of fewer than ten frames have a null pattern.
    """
    numbered = df.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= 10)
    low = F.coalesce(F.col(difference) < threshold, F.lit(False))
    heads = numbered.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", low.alias("low")))), lambda x: x["low"]).alias("__low"))
    right = lambda start, i: F.when(F.get("__low", start + i) == F.lit(i % 2 == 1), 0.25).otherwise(0.0)
    shares = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda start: sum((right(start, i) for i in (2, 3, 4)), right(start, 1)))
    own = heads.withColumn("__share", F.get(F.filter(shares, lambda x: x > 0.7), F.lit(0)))
    named = own.withColumn("pattern", F.when(F.size("__low") == 10, F.when(F.col("__share").isNotNull(), "2:2").otherwise("none")))
    rate = lambda place: F.when(F.col("pattern") == "2:2", PULLDOWN_RATES["2:2"][place]).when(F.col("pattern") == "none", PULLDOWN_RATES["none"][place])
    known = F.col("pattern").isNotNull()
    return named.select(*by, "pattern", F.when(known, F.coalesce("__share", F.lit(0.0))).alias("confidence"), rate(0).alias("original_fps"), rate(1).alias("current_fps"), F.when(known, 0).alias("phase"))


def concatenated(parts: Sequence[DataFrame], pts: str, duration: str) -> DataFrame:
    """Sources in order as one stream: times of each are moved by the length of those before.

    Columns have to agree in name and type. Null times stay null.
    """
    names = parts[0].dtypes
    for part in parts[1:]:
        if part.dtypes != names:
            raise ValueError("the sources' columns differ")
    rows = parts[0].withColumn("file_index", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        rows = rows.unionByName(part.withColumn("file_index", F.lit(k)))
    lengths = rows.groupBy("file_index").agg(F.max(F.col(pts) + F.col(duration)).alias("__length"))
    before = W.orderBy("file_index").rowsBetween(W.unboundedPreceding, -1)
    offsets = lengths.select("file_index", F.coalesce(F.sum("__length").over(before), F.lit(0)).alias("offset"))  # a row a source
    return rows.join(F.broadcast(offsets), "file_index").withColumn(pts, F.col(pts) + F.col("offset"))


def incompatible_streams(streams: DataFrame, strict: bool = False) -> DataFrame:
    """(file_index, stream_index, problem, expected, found) of streams that don't fit those of file 0.

    streams: file_index, stream_index, track_type, codec, width, height, sample_rate,
    channels. A file's number of streams is compared first (stream_index null); one
    that differs there is not compared further. Then type and codec; strict adds the
    size of pictures and the rate and channels of sound. Nulls are compared as values
    in type and codec; elsewhere a null on either side fits anything. Each stream has
    its first problem alone.
    """
    counts = streams.groupBy("file_index").agg(F.count("*").alias("__n"))
    expected = counts.where(F.col("file_index") == 0).select(F.col("__n").alias("__e"))
    sized = counts.where(F.col("file_index") != 0).join(F.broadcast(expected), how="left")  # one row
    apart = ~F.col("__n").eqNullSafe(F.col("__e"))
    text = lambda c: c.cast("string")
    missing = sized.where(apart).select("file_index", F.lit(None).cast(dict(streams.dtypes)["stream_index"]).alias("stream_index"), F.lit("stream count").alias("problem"), text(F.coalesce("__e", F.lit(0))).alias("expected"), text(F.col("__n")).alias("found"))
    first, other = streams.where(F.col("file_index") == 0).alias("a"), streams.where(F.col("file_index") != 0).join(sized.where(~apart).select("file_index"), "file_index", "left_semi").alias("b")
    both = other.join(first, "stream_index")
    size = lambda side: F.concat_ws("x", text(F.col(f"{side}.width")), text(F.col(f"{side}.height")))
    differ = lambda *names: reduce(lambda x, y: x | y, [F.coalesce(F.col(f"a.{n}") != F.col(f"b.{n}"), F.lit(False)) for n in names])
    rules = [(f"{n}", ~F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")), F.col(f"a.{n}"), F.col(f"b.{n}")) for n in ("track_type", "codec")]
    if strict:
        rules += [("resolution", differ("width", "height"), size("a"), size("b")), *[(n, differ(n), text(F.col(f"a.{n}")), text(F.col(f"b.{n}"))) for n in ("sample_rate", "channels")]]
    found = F.coalesce(*[F.when(wrong, F.struct(F.lit(name).alias("problem"), a.alias("expected"), b.alias("found"))) for name, wrong, a, b in rules])
    return missing.unionAll(both.select(F.col("b.file_index"), "stream_index", found.alias("p")).where("p is not null").select("file_index", "stream_index", "p.*"))


def train_split(df: DataFrame, order: Sequence[str], share: float) -> DataFrame:
    """is_train: the first floor(n share) rows of the order, found without a global window."""
    from lumenframe.operators.ranks import with_rank

    ranked = with_rank(df, order)
    return ranked.withColumn("is_train", F.col("rank0") < F.floor(F.col("total_rows") * F.lit(share)))
