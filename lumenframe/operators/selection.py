"""Skylines, ladders, sampling, top-k and table reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.functions.scores import bitrate_factor, predicted_ssim, predicted_vmaf, profile_class
from lumenframe.operators.ranks import in_ranges
from lumenframe.session import materialize

#: Resolutions of a ladder and bitrate multipliers; fixed values.
LADDER_SIZES = ((426, 240), (640, 360), (854, 480), (1280, 720), (1920, 1080), (2560, 1440), (3840, 2160))
LADDER_FACTORS = (0.5, 0.75, 1.0, 1.25, 1.5)
#: Limits of a ladder's bitrates (kbit/s), qualities and rungs; fixed values.
LOW_KBPS, HIGH_KBPS, LOW_VMAF, TARGET_VMAF, FEWEST_RUNGS, MOST_RUNGS = 200, 12_000, 70.0, 93.0, 3, 7


def skyline(df: DataFrame, cost: str, value: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose value is above that of every row before them by (cost, tie).

    The values are first reduced to one a cost. Without `by` the costs are dealt
    to ranges, each range has its own running maximum, and the greatest value of
    the ranges before is carried into it; no task sees all costs. Rows of one
    cost are compared in a window of their own. With `by`, each group has its own
    skyline, from one window over its rows and no join.
    """
    earlier = (W.unboundedPreceding, -1)
    if by:
        before = F.max(value).over(W.partitionBy(*by).orderBy(cost, tie).rowsBetween(*earlier))
        return df.withColumn("__before", before).where(F.coalesce(F.col(value) > F.col("__before"), F.lit(True))).drop("__before")
    best = df.groupBy(cost).agg(F.max(value).alias("__best"))
    dealt = materialize(in_ranges(best, [cost]), "skyline")
    ranges = dealt.groupBy("__range").agg(F.max("__best").alias("__most"))
    carried = ranges.select(F.col("__range").alias("__at"), F.max("__most").over(W.orderBy("__range").rowsBetween(*earlier)).alias("__carried"))
    inside = dealt.withColumn("__inside", F.max("__best").over(W.partitionBy("__range").orderBy(cost).rowsBetween(*earlier)))
    cheaper = inside.join(F.broadcast(carried), F.col("__range") == F.col("__at")).select(cost, F.greatest("__inside", "__carried").alias("__cheaper"))
    own = W.partitionBy(cost).orderBy(tie).rowsBetween(*earlier)
    seen = df.withColumn("__own", F.max(value).over(own)).join(cheaper, [cost])
    return seen.where(F.coalesce(F.col(value) > F.greatest("__own", "__cheaper"), F.lit(True))).drop("__own", "__cheaper")


def pareto_front(df: DataFrame, cost: str, value: str, tie: str, low: float, target: float, group: Sequence[str]) -> DataFrame:
    """The skyline above `low`, then one a group: the cheapest that meets the target, else the best."""
    front = skyline(df.where(F.col(value) >= low), cost, value, tie)
    meets = F.col(value) >= target
    order = W.partitionBy(*group).orderBy(meets.cast("int").desc(), F.when(meets, F.col(cost)), F.col(value).desc(), F.col(tie))
    return front.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") == 1).drop("__rank")


def evenly_sampled(df: DataFrame, order: Sequence[str], low: int, high: int) -> DataFrame:
    """Rows at even steps of the order: as many as there are, within low and high.

    Meant for ladders: the row numbers are taken over the rows given, which are
    a reduced set of candidates.
    """
    numbered = df.withColumn("__at", F.row_number().over(W.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(W.partitionBy()))
    wanted = F.least(F.greatest(F.col("__n"), F.lit(low)), F.lit(high), F.col("__n"))
    # Row a is taken if some step i * n / wanted falls into it.
    first = F.ceil(F.col("__at") * wanted / F.col("__n"))
    return numbered.where(F.floor(first * F.col("__n") / wanted) == F.col("__at")).drop("__at", "__n")


def nearest(df: DataFrame, distance: Column, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """The row of least distance; ties by `tie`."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*by).agg(F.min_by(row, F.struct(distance.alias("d"), F.col(tie))).alias("__row")).select("__row.*")


def _base_kbps(pixels: Column, fps: Column) -> Column:
    return F.floor(pixels * F.sqrt(fps / 30) / 1000).cast("int")


def _ladder_sizes(profiles: DataFrame, *columns: str) -> DataFrame:
    """Profiles x resolutions not above the source."""
    sizes = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(h).alias("height")) for w, h in LADDER_SIZES])
    rows = profiles.select(*columns, F.explode(sizes).alias("__size")).select(*columns, "__size.*")
    return rows.withColumn("pixels", F.col("width").cast("long") * F.col("height")).where(F.col("pixels") <= F.col("source_pixels"))


def ladder_candidates(profiles: DataFrame, key: str) -> DataFrame:
    """Quality points of each profile (key, complexity, fps, source_pixels).

    Every resolution up to the source's times every multiplier of its base
    bitrate and of the profile's class, with predicted VMAF and SSIM; points
    outside the limits are left out.
    """
    rows = _ladder_sizes(profiles, key, "complexity", "fps", "source_pixels").withColumn("factor", F.explode(F.array(*[F.lit(x) for x in LADDER_FACTORS])))
    own_factor = bitrate_factor(profile_class(F.col("complexity")))
    rows = rows.withColumn("kbps", (_base_kbps(F.col("pixels"), F.col("fps")) * F.col("factor") * own_factor).cast("int")).where(F.col("kbps").between(LOW_KBPS, HIGH_KBPS))
    bpp = F.col("kbps") * 1000.0 / (F.col("pixels") * F.col("fps"))
    scale = F.sqrt(F.col("pixels") / F.col("source_pixels"))
    rows = rows.withColumn("vmaf", predicted_vmaf(bpp, F.col("complexity"), scale)).withColumn("ssim", predicted_ssim(bpp, F.col("complexity")))
    return rows.where(F.col("vmaf") >= LOW_VMAF).select(key, "width", "height", "factor", "kbps", "vmaf", "ssim")


def ladder(profiles: DataFrame, key: str) -> DataFrame:
    """The rungs of each profile's ladder and its savings in percent against the static one.

    The skyline of the candidates, one point a resolution, evenly sampled to the
    allowed number of rungs. Profiles without candidates have no ladder.
    """
    points = ladder_candidates(profiles, key).withColumn("__tie", F.struct("height", "factor"))
    front = skyline(points, "kbps", "vmaf", "__tie", [key])
    meets = F.col("vmaf") >= TARGET_VMAF
    best = W.partitionBy(key, "width", "height").orderBy(meets.cast("int").desc(), F.when(meets, F.col("kbps")), F.col("vmaf").desc(), "__tie")
    front = front.withColumn("__r", F.row_number().over(best)).where(F.col("__r") == 1)
    place, whole = W.partitionBy(key).orderBy("kbps", "__tie"), W.partitionBy(key)
    front = front.withColumn("__at", F.row_number().over(place) - 1).withColumn("__n", F.count("*").over(whole))
    wanted = F.least(F.greatest(F.col("__n"), F.lit(FEWEST_RUNGS)), F.lit(MOST_RUNGS), F.col("__n"))
    rungs = front.where(F.floor(F.ceil(F.col("__at") * wanted / F.col("__n")) * F.col("__n") / wanted) == F.col("__at"))
    static = _ladder_sizes(profiles, key, "fps", "source_pixels").groupBy(key).agg(F.sum(_base_kbps(F.col("pixels"), F.col("fps"))).alias("__static"))
    # Both sides grow with the profiles, however small Spark estimates them, so neither is broadcast.
    rungs = rungs.withColumn("__sum", F.sum("kbps").over(whole)).join(static.hint("merge"), key)
    savings = F.greatest(F.when(F.col("__static") > 0, (F.col("__static") - F.col("__sum")) / F.col("__static") * 100).otherwise(0.0), F.lit(0.0))
    return rungs.select(key, "width", "height", "kbps", "vmaf", "ssim", savings.alias("savings"))


def provider_choice(jobs: DataFrame, providers: DataFrame, job: str, eligible: Column, strategy: str, preferred: str | None = None) -> DataFrame:
    """Each job's provider among the eligible ones by strategy; ties and the rest by provider.

    providers: provider, cost_per_minute, latency, active_jobs. strategy: cost,
    latency, load, preferred. The providers are a list of services, so they are
    broadcast if Spark finds them small.
    """
    orders = {"cost": F.col("cost_per_minute"), "latency": F.col("latency"), "load": F.col("active_jobs"), "preferred": (F.col("provider") != F.lit(preferred)).cast("int")}
    matched = jobs.join(providers, eligible)
    return matched.groupBy(job).agg(F.min_by("provider", F.struct(orders[strategy].alias("o"), F.col("provider"))).alias("provider"))


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows; Spark keeps n a task, so nothing is sorted whole."""
    return df.orderBy(*order).limit(n)


def pending_tasks(df: DataFrame, n: int, state: str = "state", priority: str = "priority", created: str = "created_at", tie: str = "id") -> DataFrame:
    return top(df.where(F.col(state) == "pending"), [F.col(priority).desc(), F.col(created), F.col(tie)], n)


def stale_workers(df: DataFrame, before: Column) -> DataFrame:
    return df.where((F.col("last_heartbeat") < before) & (F.col("health") != "offline"))


def healthy_workers(df: DataFrame, before: Column) -> DataFrame:
    return df.where((F.col("health") == "healthy") & (F.col("last_heartbeat") >= before))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key, and the others of new."""
    return old.join(new.select(F.col(key).alias("__new")), old[key] == F.col("__new"), "left_anti").unionByName(new)


def in_job(df: DataFrame, job: str, segment: str) -> DataFrame:
    """Tasks of each job numbered by the `index` field of their JSON segment."""
    return df.withColumn("segment_index", F.get_json_object(segment, "$.index").cast("int")).orderBy(job, "segment_index")


def tagged(df: DataFrame, key: str, tags: str, include_ids: Sequence[str] = (), exclude_ids: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Rows by id and by any of their tags; an empty list allows all."""
    words = lambda xs: F.array(*[F.lit(x) for x in xs])
    kept = df
    if include_ids:
        kept = kept.where(F.col(key).isin(*include_ids))
    if exclude_ids:
        kept = kept.where(~F.col(key).isin(*exclude_ids))
    if include:
        kept = kept.where(F.arrays_overlap(tags, words(include)))
    if exclude:
        kept = kept.where(~F.arrays_overlap(tags, words(exclude)))
    return kept
