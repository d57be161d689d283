"""Small reads of audit logs, alerts, jobs, timelines, playlists and caches: one filter or aggregate each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_value(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of one value: audit entries of a type or a job, alerts of a severity, plugins of a kind."""
    return df.where(F.col(column) == F.lit(value))


def updates_since(df: DataFrame, frame: str, last: int) -> DataFrame:
    """Updates after a frame, which is itself left out."""
    return df.where(F.col(frame) > last)


def newest_first(df: DataFrame, created: str, tie: str) -> DataFrame:
    """Jobs from the newest to the oldest; Spark sorts by ranges."""
    return df.orderBy(F.col(created).desc(), F.col(tie))


def tasks_of_worker(df: DataFrame, worker: str, own, state: str, active: Sequence[str] = ("queued", "running")) -> DataFrame:
    """A worker's active tasks."""
    return df.where((F.col(worker) == F.lit(own)) & F.col(state).isin(*active))


def clip_duration(start: Column, end: Column, speed: Column) -> Column:
    """Seconds of a clip after trim and speed; 0 where its end is not known."""
    return F.coalesce((end - start) / speed, F.lit(0.0))


def timeline_duration(clips: DataFrame, by: Sequence[str], track: str, duration: str) -> DataFrame:
    """Duration of each timeline: that of its longest track, which is the sum of its clips."""
    tracks = clips.groupBy(*by, track).agg(F.sum(duration).alias("__d"))
    return tracks.groupBy(*by).agg(F.greatest(F.max("__d"), F.lit(0.0)).alias("total_duration"))


def cues_end(cues: DataFrame, by: Sequence[str], end: str) -> DataFrame:
    """Duration of each subtitle track: its latest end."""
    return cues.groupBy(*by).agg(F.max(end).alias("duration"))


def last_parts(parts: DataFrame, by: Sequence[str], segment: str, part: str) -> DataFrame:
    """The highest part of each playlist's last segment: the first number plus the number of segments less one."""
    segments = parts.groupBy(*by, segment).agg(F.max(part).alias("__part"))
    first, n = F.min(segment), F.count("*")
    last = segments.groupBy(*by).agg((first + n - 1).alias("last_msn"), F.collect_list(F.struct(F.col(segment).alias("s"), F.col("__part").alias("p"))).alias("__parts"))
    found = F.array_max(F.transform(F.filter("__parts", lambda x: x["s"] == F.col("last_msn")), lambda x: x["p"]))
    return last.select(*by, "last_msn", found.alias("last_part"))


def jobs_snapshot(jobs: DataFrame, by: Sequence[str], completed: Column, failed: Column, seconds: str) -> DataFrame:
    """Jobs submitted, completed and failed, and the mean seconds of the completed ones; 0 for none."""
    done = F.count_if(completed)
    mean = F.when(done > 0, F.sum(F.when(completed, F.col(seconds))) / done).otherwise(0.0)
    return jobs.groupBy(*by).agg(F.count("*").alias("submitted"), done.alias("completed"), F.count_if(failed).alias("failed"), mean.alias("avg_seconds"))


def average_magnitude(vectors: DataFrame, by: Sequence[str], dx: str, dy: str) -> DataFrame:
    """Mean length of the motion vectors of each field."""
    return vectors.groupBy(*by).agg(F.coalesce(F.avg(F.hypot(F.col(dx), F.col(dy))), F.lit(0.0)).alias("magnitude"))


def cache_stats(df: DataFrame, size: Column) -> DataFrame:
    """Number of streams held and their bytes."""
    return df.agg(F.count("*").alias("streams"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))
