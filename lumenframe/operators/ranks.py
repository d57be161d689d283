"""Row numbers over a whole table without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.session import materialize


def in_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with __range: rows dealt to rising ranges of the whole order, as many as shuffle partitions at most.

    The bounds are sampled, so the result has to be written before two readers
    may rely on the same ranges.
    """
    return df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())


def with_rank(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with rank0 (from 0) in the order of the columns, and total_rows.

    Rows are dealt to ranges of the whole order, so one repeated value of its
    first column is split as well; each range is numbered by itself and moved by
    the counts of those before. Nulls come first.
    """
    dealt = materialize(in_ranges(df, order), "ranks")
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("__range").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"), F.sum("__n").over(W.partitionBy()).alias("total_rows"))
    numbered = dealt.withColumn("__row", F.row_number().over(W.partitionBy("__range").orderBy(*order)))
    joined = numbered.join(F.broadcast(offsets), F.col("__range") == F.col("__at"))
    return joined.withColumn("rank0", F.col("__offset") + F.col("__row") - 1).drop("__range", "__at", "__offset", "__row")
