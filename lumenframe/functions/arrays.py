"""Kernels over arrays of samples, as higher-order functions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def mse(a: Column, b: Column) -> Column:
    """Mean squared difference; null for arrays of different length or none."""
    squared = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total(squared) / F.size(a))


def psnr(error: Column, peak: float = 255.0) -> Column:
    """dB of a mean squared error; infinite where there is none."""
    return F.when(error == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(peak * peak) / error))


def weighted_psnr(channels: list[Column], weights: tuple[float, ...], peak: float = 255.0) -> Column:
    """PSNR of the weighted errors behind channel PSNRs; infinite channels have none."""
    error = sum((F.when(c == float("inf"), 0.0).otherwise(peak * peak / F.pow(F.lit(10.0), c / 10)) * w for c, w in zip(channels, weights, strict=True)), F.lit(0.0)) / sum(weights)
    return psnr(error, peak)


def histogram_difference(a: Column, b: Column) -> Column:
    """Sum of |a - b| over sum of a + b; 0 for empty histograms."""
    apart = total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))
    both = total(F.zip_with(a, b, lambda x, y: x.cast("double") + y))
    return F.when(both > 0, apart / both).otherwise(0.0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def content_difference(luma_a: Column, luma_b: Column, hash_a: Column, hash_b: Column) -> Column:
    return (F.abs(luma_a - luma_b) / 255 + hamming(hash_a, hash_b) / 64) / 2


def edge_difference(a: Column, b: Column) -> Column:
    most = F.greatest(a, b)
    return F.when(most > 0, F.abs(a - b) / most).otherwise(0.0)


def blend(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x * (1 - weight) + y * weight)


def blend_many(frames: Column, weights: list[float]) -> Column:
    """Weighted mean of an array of equal-length arrays; as many weights as frames."""
    scale = float(sum(weights)) or 1.0
    w = F.array(*[F.lit(x / scale) for x in weights])
    weighted = F.zip_with(frames, w, lambda f, k: F.transform(f, lambda x: x * k))
    zero = F.transform(F.element_at(frames, 1), lambda x: x * 0.0)
    return F.aggregate(weighted, zero, lambda a, f: F.zip_with(a, f, lambda x, y: x + y))


def correlate(signal: Column, sequence: Column) -> Column:
    """Dot product over the shorter length; 0 for nothing."""
    n = F.least(F.size(signal), F.size(sequence))
    dot = F.aggregate(F.zip_with(F.slice(signal, 1, n), F.slice(sequence, 1, n), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, dot / n).otherwise(0.0)


def reorder(array: Column, places: list[int]) -> Column:
    return F.array(*[F.element_at(array, p + 1) for p in places])


def gain(samples: Column, db: float) -> Column:
    return F.transform(samples, lambda x: x * (10 ** (db / 20)))


def downmix(channels: Column, matrix: list[list[float]]) -> Column:
    """Channel arrays times a matrix: one array per row of the matrix."""
    zero = F.transform(F.element_at(channels, 1), lambda x: x * 0.0)
    rows = []
    for row in matrix:
        w = F.array(*[F.lit(float(x)) for x in row])
        rows.append(F.aggregate(F.zip_with(channels, w, lambda c, k: F.transform(c, lambda x: x * k)), zero, lambda a, c: F.zip_with(a, c, lambda x, y: x + y)))
    return F.array(*rows)


def rms(samples: Column) -> Column:
    return F.when(F.size(samples) > 0, F.sqrt(total(F.transform(samples, lambda x: x.cast("double") * x)) / F.size(samples))).otherwise(0.0)


def zero_crossings(samples: Column) -> Column:
    """Share of steps at which the sign changes."""
    steps = F.zip_with(F.slice(samples, 1, F.greatest(F.size(samples) - 1, F.lit(0))), F.slice(samples, 2, F.greatest(F.size(samples) - 1, F.lit(0))), lambda x, y: ((x >= 0) != (y >= 0)).cast("double"))
    return F.when(F.size(samples) > 1, total(steps) / (F.size(samples) - 1)).otherwise(0.0)


def flip_rows(pixels: Column, width: int) -> Column:
    """Each row of a flat picture reversed."""
    rows = F.transform(F.sequence(F.lit(0), (F.size(pixels) / width).cast("int") - 1), lambda r: F.reverse(F.slice(pixels, (r * width + 1).cast("int"), width)))
    return F.flatten(rows)


def flip_columns(pixels: Column, width: int) -> Column:
    """The rows of a flat picture in reverse order."""
    rows = F.transform(F.sequence(F.lit(0), (F.size(pixels) / width).cast("int") - 1), lambda r: F.slice(pixels, (r * width + 1).cast("int"), width))
    return F.flatten(F.reverse(rows))


def transpose(pixels: Column, width: int) -> Column:
    height = F.size(pixels) / width
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.transform(F.sequence(F.lit(0), (height - 1).cast("int")), lambda r: F.element_at(pixels, (r * width + c + 1).cast("int")))))


def crop(pixels: Column, width: int, x: int, y: int, w: int, h: int) -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(y), F.lit(y + h - 1)), lambda r: F.slice(pixels, (r * width + x + 1).cast("int"), w)))
