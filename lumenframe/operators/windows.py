"""Windows over time series; always partitioned by a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.functions.timebase import micros


def moving_average(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, size: int, name: str = "moving_average") -> DataFrame:
    """Mean of the row and up to size - 1 before it; size below 1 counts as 1."""
    frame = W.partitionBy(*by).orderBy(*order).rowsBetween(-(max(size, 1) - 1), 0)
    return df.withColumn(name, F.avg(value).over(frame))


def retained(df: DataFrame, by: Sequence[str], ts: str, tie: str, seconds: float, points: int) -> DataFrame:
    """For each row, how many rows a buffer holds after it: those not older than `seconds`, at most `points`."""
    order = W.partitionBy(*by).orderBy("__us")
    own = df.withColumn("__us", micros(ts))
    held = F.count("*").over(order.rangeBetween(-int(seconds * 1_000_000), 0))
    return own.withColumn("retained", F.least(held, F.lit(points).cast("long"))).drop("__us")


def series_stats(df: DataFrame, by: Sequence[str], ts: str, value: str, tie: str) -> DataFrame:
    """latest, mean, extremes, sample deviation (0 for one row) and rate of change.

    rate: (last - first) / seconds between them; null below two rows or without
    a span. Rows of equal time are ordered by `tie`.
    """
    first, last = F.min(F.struct(ts, tie, value)), F.max(F.struct(ts, tie, value))
    own = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("average"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_samp(value).alias("__s"), first.alias("__f"), last.alias("__l"))
    span = (micros(F.col(f"__l.{ts}")) - micros(F.col(f"__f.{ts}"))) / 1_000_000
    return own.select(
        *by,
        "n",
        F.col(f"__l.{value}").alias("latest"),
        "average",
        "min",
        "max",
        F.coalesce("__s", F.when(F.col("n") == 1, 0.0)).alias("std_dev"),
        F.when((F.col("n") > 1) & (span > 0), (F.col(f"__l.{value}") - F.col(f"__f.{value}")) / span).alias("rate_of_change"),
    )


def bitrate_history(df: DataFrame, by: Sequence[str], order: Sequence[str], size: str, seconds: str) -> DataFrame:
    """Running bits per running second / 1000; rows before any time has passed are left out."""
    run = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = df.withColumn("running_bytes", F.sum(size).over(run)).withColumn("running_time", F.sum(seconds).over(run)).where(F.col("running_time") > 0)
    return own.withColumn("kbps", F.col("running_bytes") * 8 / F.col("running_time") / 1000)


def adaptive_threshold(df: DataFrame, by: Sequence[str], order: Sequence[str], score: str, fixed: float = 0.3, warm: int = 10, low: float = 0.1, high: float = 0.8) -> DataFrame:
    """Running mean + 2 population deviations of the scores so far, this one included.

    Within low to high; the fixed threshold holds until `warm` scores are seen.
    """
    run = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = df.withColumn("seen", F.count(score).over(run)).withColumn("mean_score", F.avg(score).over(run)).withColumn("dev_score", F.stddev_pop(score).over(run))
    adaptive = F.least(F.greatest(F.col("mean_score") + 2 * F.col("dev_score"), F.lit(low)), F.lit(high))
    return own.withColumn("threshold", F.when(F.col("seen") >= warm, adaptive).otherwise(F.lit(fixed)))


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], cut: str, place: str, score: str) -> DataFrame:
    """Segments between cuts: a cut row after the first begins a segment.

    The score of the cut that ends a segment is its confidence; the last has 1.
    """
    ordered = W.partitionBy(*by).orderBy(*order)
    starts = F.when(F.row_number().over(ordered) == 1, False).otherwise(F.col(cut))
    own = df.withColumn("__start", starts).withColumn("segment", F.sum(F.col("__start").cast("long")).over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    own = own.withColumn("__next", F.when(F.lead("__start").over(ordered), F.lead(score).over(ordered)))
    return own.groupBy(*by, "segment").agg(F.min(place).alias("start"), F.max(place).alias("end"), F.count("*").alias("rows"), F.coalesce(F.max("__next"), F.lit(1.0)).alias("confidence"))


def gop_types(df: DataFrame, by: Sequence[str], order: Sequence[str], complexity: str, gop: int = 12, b_frames: int = 2, jump: float = 0.5) -> DataFrame:
    """I at the start of each group of `gop` rows, P every b_frames + 1 (0: always), else B; a rise of complexity by more than `jump` makes an I."""
    ordered = W.partitionBy(*by).orderBy(*order)
    place = F.pmod(F.row_number().over(ordered) - 1, F.lit(gop))
    before = F.lag(complexity).over(ordered)
    jumped = F.coalesce((before > 0) & ((F.col(complexity) - before) / before > jump), F.lit(False))
    return df.withColumn("frame_type", F.when((place == 0) | jumped, "I").when(F.pmod(place, F.lit(b_frames + 1)) == 0, "P").otherwise("B"))


def with_previous(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    return df.withColumn("previous", F.lag(value).over(W.partitionBy(*by).orderBy(*order)))
