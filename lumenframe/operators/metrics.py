"""Aggregations over frame metrics, jobs, tests and costs.

Every operator is one scan and at most one shuffle on its keys; partial sums are
made before it. Empty inputs follow the semantics in the docstrings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.functions.timebase import micros

INF = float("inf")


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """The last `size` rows of each group in the order of `order`."""
    place = W.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__place", F.row_number().over(place)).where(F.col("__place") <= size).drop("__place")


def realtime_stats(df: DataFrame, by: Sequence[str], ts: str, size: str, encode_time: str, psnr: str) -> DataFrame:
    """Rates of each stream over its event time.

    fps: rows per second from the first to the last row; kbps: bits per second /
    1000; quality: mean PSNR, at most 100, and 100 where there is none. A stream
    of no duration has rates 0.
    """
    span = ((F.max(micros(ts)) - F.min(micros(ts))) / 1_000_000).alias("elapsed")
    own = df.groupBy(*by).agg(F.count("*").alias("frames"), F.sum(size).alias("bytes"), F.avg(encode_time).alias("avg_encode_time"), F.avg(psnr).alias("avg_psnr"), span)
    per_second = lambda x: F.when(F.col("elapsed") > 0, x / F.col("elapsed")).otherwise(0.0)
    return own.select(
        *by,
        "frames",
        "bytes",
        per_second(F.col("frames")).alias("fps"),
        per_second(F.col("bytes") * 8 / 1000).alias("kbps"),
        F.coalesce("avg_encode_time", F.lit(0.0)).alias("avg_encode_time"),
        F.least(F.coalesce("avg_psnr", F.lit(100.0)), F.lit(100.0)).alias("quality"),
    )


def mixed_report(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, size: str, encode_time: str, psnr: str, ssim: str, ring: int) -> DataFrame:
    """A report of two scopes: frames, bytes and mean PSNR of all rows; rates, quality and mean SSIM of the last `ring`.

    avg_psnr and avg_ssim are null where no row has one.
    """
    recent = latest(df, by, order, ring)
    rates = realtime_stats(recent, by, ts, size, encode_time, psnr).select(*by, "fps", "kbps", "quality")
    whole = df.groupBy(*by).agg(F.count("*").alias("total_frames"), F.sum(size).alias("total_bytes"), F.avg(psnr).alias("avg_psnr"))
    return whole.join(rates, list(by)).join(recent.groupBy(*by).agg(F.avg(ssim).alias("avg_ssim")), list(by))


def type_distribution(df: DataFrame, by: Sequence[str], kind: str) -> DataFrame:
    """Count and share of each kind in its group."""
    counted = df.groupBy(*by, kind).agg(F.count("*").alias("n"))
    return counted.withColumn("ratio", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def encoding_metrics(df: DataFrame, by: Sequence[str], time: str, size: str, fps: float) -> DataFrame:
    """Count, sums, extremes and the mean bitrate (kbit/s) at a frame rate; 0 for no frames."""
    return df.groupBy(*by).agg(
        F.count("*").alias("frames"),
        F.sum(time).alias("total_time"),
        F.min(time).alias("min_time"),
        F.max(time).alias("max_time"),
        F.sum(size).alias("total_bytes"),
        F.coalesce(F.sum(size) * 8 / (F.count("*") / F.lit(float(fps))) / 1000, F.lit(0.0)).alias("avg_kbps"),
    )


def quality_metrics(df: DataFrame, by: Sequence[str], psnr: str, ssim: str, compat: bool = False) -> DataFrame:
    """Means and extremes of PSNR and SSIM; compat divides the SSIM sum by the PSNR count."""
    mean = F.sum(ssim) / F.nullif(F.count(psnr), F.lit(0)) if compat else F.avg(ssim)
    return df.groupBy(*by).agg(F.count(psnr).alias("samples"), F.avg(psnr).alias("avg_psnr"), F.min(psnr).alias("min_psnr"), F.max(psnr).alias("max_psnr"), mean.alias("avg_ssim"), F.min(ssim).alias("min_ssim"), F.max(ssim).alias("max_ssim"))


def bitrate_stats(df: DataFrame, by: Sequence[str], kbps: str, target: float, tolerance: float) -> DataFrame:
    """Extremes (0 is no minimum), mean, population variance, and whether the mean is on target."""
    own = df.groupBy(*by).agg(F.min(F.when(F.col(kbps) != 0, F.col(kbps))).alias("min_kbps"), F.max(kbps).alias("max_kbps"), F.avg(kbps).alias("avg_kbps"), F.var_pop(kbps).alias("var_kbps"))
    return own.withColumn("on_target", F.abs(F.col("avg_kbps") - target) / F.lit(float(target)) <= tolerance if target else F.lit(None).cast("boolean"))


def wide_by_metric(df: DataFrame, by: Sequence[str], metric: str, value: str, order: str, metrics: Sequence[str]) -> DataFrame:
    """Long to wide; of several values of a metric the one of the greatest `order` wins."""
    return df.groupBy(*by).agg(*[F.max_by(F.when(F.col(metric) == m, F.col(value)), F.when(F.col(metric) == m, F.col(order))).alias(m) for m in metrics])


def long_by_metric(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide to long, without nulls."""
    return df.unpivot(list(by), list(metrics), "metric", "value").where(F.col("value").isNotNull())


def summary(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """avg, min and max of each metric; without values 0, infinity and minus infinity."""
    parts = []
    for m in metrics:
        parts += [F.coalesce(F.avg(m), F.lit(0.0)).alias(f"avg_{m}"), F.coalesce(F.min(m), F.lit(INF)).alias(f"min_{m}"), F.coalesce(F.max(m), F.lit(-INF)).alias(f"max_{m}")]
    return df.groupBy(*by).agg(*parts)


def finite_mean(value: str) -> Column:
    """Mean without infinities, NaN and nulls; null if none is left."""
    return F.avg(F.when(F.abs(F.col(value)) < INF, F.col(value)))


def finite_min(value: str) -> Column:
    return F.min(F.when(F.abs(F.col(value)) < INF, F.col(value)))


def histogram(df: DataFrame, by: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative bucket counts (value <= le, then +Inf as null le), with sum, count and mean."""
    counts = [F.count_if(F.col(value) <= b) for b in bounds]
    own = df.groupBy(*by).agg(F.array(*counts, F.count(value)).alias("__buckets"), F.sum(value).alias("sum"), F.count(value).alias("count"))
    les = F.array(*[F.lit(float(b)) for b in bounds], F.lit(None).cast("double"))
    rows = own.select(*by, F.explode(F.arrays_zip(les.alias("le"), F.col("__buckets").alias("n"))).alias("bucket"), "sum", "count")
    return rows.select(*by, F.col("bucket.le").alias("le"), F.col("bucket.n").alias("cumulative"), "sum", "count", F.coalesce(F.col("sum") / F.nullif("count", F.lit(0)), F.lit(0.0)).alias("mean"))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """count, sum, mean, min, max and the values at sorted place min(floor(n p), n - 1).

    The places are found by a window in each group, so no group is gathered in
    a list. Empty groups don't exist; nulls don't count.
    """
    order = W.partitionBy(*by).orderBy(value)
    ranked = df.where(F.col(value).isNotNull()).select(*by, value, (F.row_number().over(order) - 1).alias("__at"), F.count("*").over(W.partitionBy(*by)).alias("__n"))
    at = lambda p: F.least(F.floor(F.col("__n") * F.lit(p)), F.col("__n") - 1)
    picked = [F.max(F.when(F.col("__at") == at(p), F.col(value))).alias(name) for name, p in shares.items()]
    return ranked.groupBy(*by).agg(F.count("*").alias("count"), F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), *picked)


def bench_stats(df: DataFrame, by: Sequence[str], seconds: str, items: float) -> DataFrame:
    """mean, extremes, population and sample deviation (0 below 2 rows), items per second."""
    return df.groupBy(*by).agg(
        F.avg(seconds).alias("mean"),
        F.min(seconds).alias("min"),
        F.max(seconds).alias("max"),
        F.stddev_pop(seconds).alias("std_pop"),
        F.coalesce(F.stddev_samp(seconds), F.lit(0.0)).alias("std_samp"),
        F.when(F.avg(seconds) > 0, F.lit(float(items)) / F.avg(seconds)).otherwise(0.0).alias("throughput"),
    )


def share(condition: Column, empty: float = 0.0, scale: float = 1.0) -> Column:
    """Share of rows that meet a condition, times scale; `empty` without rows."""
    return F.coalesce(F.avg(condition.cast("double")) * scale, F.lit(empty))


def integer_mean(total: str) -> Column:
    """Integer division of a sum by its count; null without rows."""
    return F.expr(f"sum({total}) div nullif(count({total}), 0)")


def job_progress(tasks: DataFrame, job: str, state: str, progress: str, previous: str) -> DataFrame:
    """Progress and state of each job from its tasks.

    All completed, then all cancelled, then any failed with none running, then
    any running; else the previous state (the smallest of the group) stays.
    """
    s = F.col(state)
    decided = (
        F.when(F.bool_and(s == "completed"), "completed").when(F.bool_and(s == "cancelled"), "cancelled").when(F.bool_or(s == "failed") & ~F.bool_or(s == "running"), "failed").when(F.bool_or(s == "running"), "running").otherwise(F.min(previous))
    )
    return tasks.groupBy(job).agg(F.avg(progress).alias("progress"), decided.alias("state"), F.count("*").alias("tasks"))


def state_counts(df: DataFrame, by: Sequence[str], state: str, states: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(F.col(state) == s).alias(s) for s in states], F.count("*").alias("total"))


def audit_report(df: DataFrame, by: Sequence[str], kind: str, check: str, violation: str) -> DataFrame:
    """Checks, violations and rate 1 - violations / checks (may be below 0; 1 without checks)."""
    checks, bad = F.count_if(F.col(kind) == check), F.count_if(F.col(kind) == violation)
    return df.groupBy(*by).agg(F.count("*").alias("entries"), checks.alias("checks"), bad.alias("violations"), F.when(checks > 0, 1 - bad / checks).otherwise(1.0).alias("compliance_rate"))


def error_counts(df: DataFrame, kind: str, ts: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("n"), F.max(ts).alias("last_ts"))


def gauge(df: DataFrame, by: Sequence[str], value: str, ts: str) -> DataFrame:
    """The value of the latest row."""
    return df.groupBy(*by).agg(F.max_by(value, ts).alias("value"))


def worst_status(df: DataFrame, by: Sequence[str], status: str) -> DataFrame:
    """unhealthy before degraded before healthy; unknown statuses count as degraded."""
    rank = F.when(F.col(status) == "unhealthy", 2).when(F.col(status) == "healthy", 0).otherwise(1)
    return df.groupBy(*by).agg(F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), F.max(rank) + 1).alias("status"), F.count("*").alias("checks"))


def estimated_storage(bitrate_kbps: str, seconds: str) -> Column:
    """Bytes of all rungs: bitrate x 1000 x whole seconds, divided by 8 row by row."""
    return F.expr(f"sum({bitrate_kbps} * 1000 * cast({seconds} as bigint) div 8)")


def cost(rates: DataFrame, minutes: float, storage_gb: float, transfer_gb: float) -> DataFrame:
    """Linear cost of a job at each provider, cheapest first; ties by provider.

    rates: provider, per_minute, per_gb_storage, per_gb_transfer.
    """
    parts = {"compute_cost": F.col("per_minute") * minutes, "storage_cost": F.col("per_gb_storage") * storage_gb, "transfer_cost": F.col("per_gb_transfer") * transfer_gb}
    own = rates.select("provider", *[c.alias(n) for n, c in parts.items()])
    return own.withColumn("total_cost", reduce(lambda a, b: a + b, [F.col(n) for n in parts])).orderBy("total_cost", "provider")


def cheapest(costs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return costs.groupBy(*by).agg(F.min(F.struct("total_cost", "provider")).alias("best")).select(*by, "best.provider", "best.total_cost")


def majority_bits(df: DataFrame, by: Sequence[str], bits: str) -> DataFrame:
    """Vote over rows for each place of an array of booleans.

    A tie is false. confidence: share of the larger side among the votes. A
    place with nulls alone has a null bit; callers treat that as an error.
    """
    votes = df.select(*by, F.posexplode(bits).alias("pos", "bit")).groupBy(*by, "pos").agg(F.count_if("bit").alias("ones"), F.count_if(~F.col("bit")).alias("zeros"))
    total = F.col("ones") + F.col("zeros")
    return votes.select(*by, "pos", F.when(total > 0, F.col("ones") > F.col("zeros")).alias("bit"), (F.greatest("ones", "zeros") / F.nullif(total, F.lit(0))).alias("confidence"))


def interlace_type(df: DataFrame, by: Sequence[str], kind: str, least: int = 10, threshold: float = 0.5) -> DataFrame:
    """Content type of analysed frames: progressive, top or bottom (field first).

    Unknown below `least` frames, Progressive below a tenth of interlaced ones,
    Interlaced above the threshold, else Mixed. The field order is the top's if
    it has more than half of all frames (halves rounded down).
    """
    n, inter, top = F.count("*"), F.count_if(F.col(kind) != "progressive"), F.count_if(F.col(kind) == "top")
    ratio = inter / n
    return df.groupBy(*by).agg(
        ratio.alias("ratio"),
        F.when(n < least, "Unknown").when(ratio < 0.1, "Progressive").when(ratio > threshold, "Interlaced").otherwise("Mixed").alias("content"),
        F.when((n >= least) & (ratio > threshold), F.when(top > F.floor(n / 2), "TopFieldFirst").otherwise("BottomFieldFirst")).alias("field_order"),
    )


def content_features(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Features of frame rows (variance, mean, motion, scene_change, edge_density, detail), each within 0 to 1.

    Scene changes are counted from the second frame on, a second of 30 frames;
    color_variance and grain_level are constants until something measures them.
    """
    ordered = W.partitionBy(*by).orderBy(*order)
    before = F.lag("mean").over(ordered)
    own = df.withColumn("__step", F.abs(F.col("mean") - before)).withColumn("__cut", F.when(before.isNotNull(), F.col("scene_change").cast("int")))
    unit = lambda c, high: F.least(F.greatest(c / high, F.lit(0.0)), F.lit(1.0))
    spatial, edges = F.avg("variance"), F.avg("edge_density")
    return own.groupBy(*by).agg(
        unit(spatial, 100).alias("spatial_complexity"),
        unit(F.coalesce(F.avg("__step"), F.lit(0.0)), 50).alias("temporal_complexity"),
        unit(F.avg("motion"), 1).alias("motion_magnitude"),
        unit(F.coalesce(F.sum("__cut"), F.lit(0)) / F.greatest(F.count("*") / 30, F.lit(1.0)), 2).alias("scene_change_rate"),
        F.lit(0.5).alias("color_variance"),
        unit(edges, 1).alias("edge_density"),
        unit(spatial * edges, 50).alias("texture_complexity"),
        F.avg((F.col("mean") < 50).cast("double")).alias("dark_ratio"),
        unit(F.avg("detail"), 1).alias("detail_ratio"),
        F.lit(0.1).alias("grain_level"),
    )


def mean_absolute_error(df: DataFrame, by: Sequence[str], predicted: str, observed: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(predicted) - F.col(observed))).alias("mae"), F.count("*").alias("n"))
