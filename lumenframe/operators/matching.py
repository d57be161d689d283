"""Joins: pairing, lookups, as-of matches and theta joins with a best choice."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.functions.timebase import micros


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, value: str, tie: str, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with the latest right row at or before it: right_ts and right_value.

    A union sorted once by stream and time; the last right row is carried
    forward, so no pair is made that isn't a match. Right rows of equal time are
    ordered by `tie`. Without a match both are null. With `bucket`, a rising
    function of the time, a stream is sorted bucket by bucket: each bucket gets
    the last right row before it from a window over one row a bucket, so a
    stream that holds much of the table is dealt over many tasks.
    """
    columns = left.columns
    sides = left.withColumns({"__side": F.lit(1), "__order": F.lit(None).cast("long"), "__value": F.lit(None).cast("double")})
    other = right.select(*by, ts, F.col(tie).cast("long").alias("__order"), F.col(value).cast("double").alias("__value")).withColumn("__side", F.lit(0))
    both = sides.unionByName(other, allowMissingColumns=True)
    keys = list(by)
    if bucket is not None:
        both, keys = both.withColumn("__bucket", bucket(F.col(ts))), [*by, "__bucket"]
    row = F.when(F.col("__side") == 0, F.struct(F.col(ts).alias("ts"), F.col("__order").alias("order"), F.col("__value").alias("value")))
    before = W.partitionBy(*keys).orderBy(ts, "__side", "__order").rowsBetween(W.unboundedPreceding, 0)
    matched = both.withColumn("__match", F.last(row, ignorenulls=True).over(before)).where(F.col("__side") == 1)
    if bucket is not None:
        earlier = W.partitionBy(*by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
        last = both.groupBy(*keys).agg(F.max(row).alias("__last"))
        carried = last.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
        matched = matched.join(carried, same, "left").withColumn("__match", F.coalesce("__match", "__carried"))
    return matched.select(*columns, F.col("__match.ts").alias("right_ts"), F.col("__match.value").alias("right_value"))


def synchronized(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, value: str, tie: str, max_drift_us: int, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows whose latest master row is at most max_drift_us away; others are dropped."""
    matched = as_of(left, right, by, ts, value, tie, bucket)
    drift = micros(ts) - micros("right_ts")
    return matched.withColumn("drift_us", drift).where(F.abs("drift_us") <= max_drift_us)


def surrounding(df: DataFrame, keyframes: DataFrame, by: Sequence[str], at: str, value: str, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """df with the keyframes around `at`: prev_at, prev_value (at or before) and next_at, next_value (after).

    Two running windows over a union, one forwards and one backwards, so the work
    is linear in the rows. With `bucket`, a rising function of the place, a stream
    is dealt over tasks bucket by bucket, as in as_of().
    """
    columns = df.columns
    sides = df.withColumns({"__side": F.lit(1), "__value": F.lit(None).cast("double")})
    both = sides.unionByName(keyframes.select(*by, at, F.col(value).cast("double").alias("__value")).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    keys = list(by)
    if bucket is not None:
        both, keys = both.withColumn("__bucket", bucket(F.col(at))), [*by, "__bucket"]
    point = F.when(F.col("__side") == 0, F.struct(F.col(at).alias("at"), F.col("__value").alias("value")))
    order, until_now = (F.col(at), F.col("__side")), (W.unboundedPreceding, 0)
    prev = F.last(point, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(*until_now))
    following = F.last(point, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*[c.desc() for c in order]).rowsBetween(*until_now))
    found = both.withColumn("__prev", prev).withColumn("__next", following).where(F.col("__side") == 1)
    if bucket is not None:
        ends = both.groupBy(*keys).agg(F.min(point).alias("__first"), F.max(point).alias("__last"))
        side = lambda c: W.partitionBy(*by).orderBy(c).rowsBetween(W.unboundedPreceding, -1)
        carried = ends.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.last("__last", ignorenulls=True).over(side(F.col("__bucket"))).alias("__before"), F.last("__first", ignorenulls=True).over(side(F.col("__bucket").desc())).alias("__after"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
        found = found.join(carried, same, "left").withColumns({"__prev": F.coalesce("__prev", "__before"), "__next": F.coalesce("__next", "__after")})
    return found.select(*columns, F.col("__prev.at").alias("prev_at"), F.col("__prev.value").alias("prev_value"), F.col("__next.at").alias("next_at"), F.col("__next.value").alias("next_value"))


def interpolated(df: DataFrame, at: str, mode: str = "linear") -> Column:
    """Value between the surrounding keyframes: step, linear or smooth; the nearest one outside."""
    share = (F.col(at) - F.col("prev_at")) / (F.col("next_at") - F.col("prev_at"))
    if mode == "step":
        return F.coalesce("prev_value", "next_value")
    if mode == "smooth":
        share = share * share * (3 - 2 * share)
    return F.when(F.col("prev_at").isNull(), F.col("next_value")).when(F.col("next_at").isNull(), F.col("prev_value")).otherwise(F.col("prev_value") + (F.col("next_value") - F.col("prev_value")) * share)


def regular_grid(df: DataFrame, by: Sequence[str], at: str, step: int) -> DataFrame:
    """Points every `step` from the first to the last `at` of each stream."""
    ends = df.groupBy(*by).agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"))
    return ends.select(*by, F.explode(F.sequence("__lo", "__hi", F.lit(step).cast("long"))).alias(at))


def paired(reference: DataFrame, distorted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of both sides of the same place; columns of the second get the suffix _dist."""
    other = distorted.select(*on, *[F.col(c).alias(f"{c}_dist") for c in distorted.columns if c not in on])
    return reference.join(other, list(on))


def mapped_streams(packets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Packets with their destination; the first mapping (smallest `ord`) of a source wins, others are dropped.

    Spark broadcasts the mapping where it finds it small.
    """
    first = mapping.groupBy("source_index").agg(F.min_by("dest_index", "ord").alias("dest_index"))
    return packets.join(first, packets["stream_index"] == first["source_index"]).drop("source_index")


def best_worker(tasks: DataFrame, workers: DataFrame, by: Sequence[str], eligible: Column, preferred: Column, load: str, tie: str, needs: Sequence[str] | None = None) -> DataFrame:
    """For each task the eligible worker: preferred ones first, then the least load, then `tie`.

    The join is on the eligibility's equalities. needs: the columns of tasks that
    `eligible` and `preferred` read, all if not given; tasks alike in them have the
    same worker, so the choice among all workers is made once for each different
    one and joined to the tasks, and no task meets every worker. Nulls of load
    and tie come first.
    """
    needed = list(tasks.columns if needs is None else needs)
    kinds = tasks.select(*needed).distinct()
    order = F.struct((~F.coalesce(preferred, F.lit(False))).alias("p"), F.col(load), F.col(tie))
    worker = F.struct(*[F.col(c) for c in workers.columns])
    best = kinds.join(workers, eligible).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(needed)], worker.alias("__worker"), order.alias("__order"))
    best = best.groupBy(*[f"__k{i}" for i in range(len(needed))]).agg(F.min_by("__worker", "__order").alias("__worker"), F.min("__order").alias("__order"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(needed)])
    rows = tasks.join(best, same).select(F.struct(*[F.col(c) for c in tasks.columns], "__worker.*").alias("__best"), "__order", *by)
    return rows.groupBy(*by).agg(F.min_by("__best", "__order").alias("__best")).select("__best.*")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of each rule that a row breaks; rules: name to the condition of a breach."""
    broken = F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()])
    return rows.select(key, F.explode(F.array_compact(broken)).alias("rule"))


def unreferenced(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key is not among the others'."""
    return rows.join(others.select(F.col(other_key).alias("__key")).distinct(), rows[key] == F.col("__key"), "left_anti")


def verified_frames(frames: DataFrame, expected: DataFrame, on: Sequence[str]) -> DataFrame:
    """SHA-256 of the planes joined to the expected ones; ok is false also where none is expected."""
    own = frames.select(*on, F.sha2(F.concat("y", "u", "v"), 256).alias("digest"))
    return own.join(expected.select(*on, F.col("digest").alias("__expected")), list(on), "left").select(*on, "digest", F.coalesce(F.col("digest") == F.col("__expected"), F.lit(False)).alias("ok"))
