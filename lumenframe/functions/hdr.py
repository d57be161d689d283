"""Tone mapping of linear RGB by luminance, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.scores import clamp

#: Luminance weights of ITU-R BT.709 and BT.2020; fixed values.
BT709 = (0.2126, 0.7152, 0.0722)
BT2020 = (0.2627, 0.6780, 0.0593)
#: Constants of the published filmic curve; fixed values.
FILMIC = {"shoulder": 0.15, "linear": 0.50, "angle": 0.10, "toe": 0.20, "toe_top": 0.02, "toe_bottom": 0.30}
FILMIC_WHITE = 11.2


def luminance(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = BT709) -> Column:
    return r * weights[0] + g * weights[1] + b * weights[2]


def reinhard(x: Column, white: float | None = None) -> Column:
    """x / (1 + x), or its form that maps `white` to 1."""
    return x / (1 + x) if white is None else x * (1 + x / (white * white)) / (1 + x)


def filmic(x: Column) -> Column:
    """The curve scaled so that its white is 1."""
    k = FILMIC

    def part(v):
        top = v * (k["shoulder"] * v + k["angle"] * k["linear"]) + k["toe"] * k["toe_top"]
        bottom = v * (k["shoulder"] * v + k["linear"]) + k["toe"] * k["toe_bottom"]
        return top / bottom - k["toe_top"] / k["toe_bottom"]

    return part(x) / part(FILMIC_WHITE)


def tone_mapped(r: Column, g: Column, b: Column, curve, source_peak: float, target_peak: float, knee: float = 0.8, desaturation: float = 0.0, weights: tuple[float, float, float] = BT709) -> Column:
    """struct(r, g, b): the colour scaled by what the curve makes of its luminance.

    The luminance is taken in units of the target's peak and mapped into 0 to 1.
    Above the knee the colour moves towards grey by up to `desaturation`. Black
    and below stay black.
    """
    y = luminance(r, g, b, weights)
    mapped = clamp(curve(y * (source_peak / target_peak)), 0, 1)
    ratio = mapped / F.nullif(y, F.lit(0.0))
    grey = clamp((mapped - knee) / (1 - knee), 0, 1) * desaturation
    own = lambda c: F.when(y > 0, F.greatest(c * ratio * (1 - grey) + mapped * grey, F.lit(0.0))).otherwise(0.0)
    return F.struct(own(r).alias("r"), own(g).alias("g"), own(b).alias("b"))
