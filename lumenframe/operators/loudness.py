"""Gated loudness of sample streams, one row a sample."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.functions.scores import power_to_lufs
from lumenframe.operators.recurrences import Fold, _closed, _schema, folded

ABSOLUTE_GATE, RELATIVE_GATE, RANGE_GATE = -70.0, -10.0, -20.0

#: The K-weighting of ITU-R BS.1770: frequency and Q of its shelf and its high pass, the shelf's gain and its exponent; fixed values.
SHELF_HZ, SHELF_Q, SHELF_DB, SHELF_EXPONENT = 1681.974450955533, 0.7071752369554196, 4.0, 0.4996667741545416
HIGH_PASS_HZ, HIGH_PASS_Q = 38.13547087602444, 0.5003270373238773
#: Weights of channels that are not 1, by number of channels; fixed values.
CHANNEL_WEIGHTS = {3: {2: 0.0}, 6: {3: 0.0, 4: 1.41, 5: 1.41}, 8: {3: 0.0, 4: 1.41, 5: 1.41, 6: 1.41, 7: 1.41}}


def biquads(rate: int) -> list[tuple[float, float, float, float, float]]:
    """(b0, b1, b2, a1, a2) of the shelf and the high pass at a sample rate."""
    out = []
    for hertz, q, gain in ((SHELF_HZ, SHELF_Q, 10 ** (SHELF_DB / 20)), (HIGH_PASS_HZ, HIGH_PASS_Q, None)):
        k = math.tan(math.pi * hertz / rate)
        norm = 1 + k / q + k * k
        if gain is None:
            top = (1.0, -2.0, 1.0)
        else:
            edge = gain**SHELF_EXPONENT * k / q
            top = (gain + edge + k * k, 2 * (k * k - gain), gain - edge + k * k)
        out.append((*[b / norm for b in top], 2 * (k * k - 1) / norm, (1 - k / q + k * k) / norm))
    return out


def k_weighted(df: DataFrame, by: Sequence[str], place: str, value: str, rate: int) -> DataFrame:
    """df with `weighted`: each channel's samples, in order of place, through both filters; a null sample counts as 0.

    by: the stream and the channel. The filters carry four numbers each from one
    batch to the next.
    """

    def fold() -> Fold:
        filters, past, chunk = biquads(rate), [[0.0] * 4, [0.0] * 4], (yield None)
        while chunk is not None:
            out = []
            for x in chunk.column(value).to_pylist():
                y = float(x or 0.0)
                for (b0, b1, b2, a1, a2), p in zip(filters, past, strict=True):
                    made = b0 * y + b1 * p[0] + b2 * p[1] - a1 * p[2] - a2 * p[3]
                    p[:] = y, p[0], made, p[2]
                    y = made
                out.append(y)
            chunk = yield chunk.append_column("weighted", pa.array(out, pa.float64()))

    return folded(df, by, [place], lambda: _closed(fold()), _schema(df, df.columns, "weighted double"))


def channel_weight(channel: Column, channels: int) -> Column:
    """The weight of a channel (from 0): surround 1.41, low frequencies 0, others 1."""
    own = CHANNEL_WEIGHTS.get(channels, {})
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in own.items() for x in pair]), channel) if own else F.lit(1.0), F.lit(1.0))


def weighted_blocks(df: DataFrame, by: Sequence[str], channel: str, place: str, value: str, rate: int, channels: int, step: int) -> DataFrame:
    """block_powers() of K-weighted channels: the weighted powers of all channels of a step added up."""
    filtered = k_weighted(df, [*by, channel], place, value, rate)
    power = F.col("weighted") * F.col("weighted") * channel_weight(F.col(channel), channels)
    steps = filtered.groupBy(*by, F.floor(F.col(place) / step).alias("block")).agg((F.sum(power) / F.countDistinct(place)).alias("power"))
    return steps.withColumn("lufs", power_to_lufs(F.col("power")))


def block_powers(df: DataFrame, by: Sequence[str], place: str, value: str, step: int) -> DataFrame:
    """Mean power of steps of `step` samples that don't overlap, with their loudness."""
    own = df.groupBy(*by, F.floor(F.col(place) / step).alias("block")).agg(F.avg(F.col(value) * F.col(value)).alias("power"))
    return own.withColumn("lufs", power_to_lufs(F.col("power")))


def _gated(blocks: DataFrame, by: Sequence[str], relative: float) -> DataFrame:
    """Blocks above the absolute gate and above the mean of those plus `relative`."""
    above = blocks.where(F.col("lufs") >= ABSOLUTE_GATE)
    gate = power_to_lufs(F.avg("power").over(W.partitionBy(*by))) + relative
    return above.withColumn("__gate", gate).where(F.col("lufs") >= F.col("__gate"))


def integrated(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two-pass gated loudness of each stream; minus infinity where every block is gated."""
    kept = _gated(blocks, by, RELATIVE_GATE).groupBy(*by).agg(F.avg("power").alias("__p"), F.count("*").alias("kept"))
    return blocks.select(*by).distinct().join(kept, list(by), "left").select(*by, F.coalesce(power_to_lufs(F.col("__p")), F.lit(float("-inf"))).alias("integrated"), F.coalesce("kept", F.lit(0)).alias("blocks"))


def loudness_range(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """The block at place min(ceil(0.95 n), n - 1) less that at floor(0.1 n) of the gated blocks."""
    kept = _gated(blocks, by, RANGE_GATE)
    order = W.partitionBy(*by).orderBy("lufs")
    ranked = kept.withColumn("__at", F.row_number().over(order) - 1).withColumn("__n", F.count("*").over(W.partitionBy(*by)))
    high, low = F.least(F.ceil(F.col("__n") * 0.95), F.col("__n") - 1), F.floor(F.col("__n") * 0.1)
    own = ranked.groupBy(*by).agg(F.max(F.when(F.col("__at") == high, F.col("lufs"))).alias("__h"), F.max(F.when(F.col("__at") == low, F.col("lufs"))).alias("__l"))
    return own.select(*by, (F.col("__h") - F.col("__l")).alias("lra"))


def sliding(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, size: int, name: str) -> DataFrame:
    """Loudness of the last `size` samples at each sample, and its running maximum."""
    frame = W.partitionBy(*by).orderBy(*order)
    mean = F.avg(F.col(value) * F.col(value)).over(frame.rowsBetween(-(size - 1), 0))
    own = df.withColumn(name, power_to_lufs(mean))
    return own.withColumn(f"max_{name}", F.max(name).over(frame.rowsBetween(W.unboundedPreceding, 0)))


def normalization_gain(loudness: Column, peak_db: Column, target: float, max_gain: float, peak_limit: float) -> Column:
    """Gain to the target, at most max_gain and what the peak leaves."""
    return F.least(F.lit(target) - loudness, F.lit(max_gain), F.lit(peak_limit) - peak_db)
