"""Picture and signal kernels in numpy, applied to Arrow batches of rows.

A frame is a flat array of luma samples with its width. Batches are whole Arrow
batches: no row is visited by Spark one at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
#: Weights of the scales of MS-SSIM; fixed values.
SCALES = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def picture(flat, width: int) -> np.ndarray:
    return np.asarray(flat, float).reshape(-1, int(width))


def _windows(a: np.ndarray, size: int) -> np.ndarray:
    size = min(size, *a.shape)
    return np.lib.stride_tricks.sliding_window_view(a, (size, size))


def ssim_parts(a: np.ndarray, b: np.ndarray, size: int = 8) -> tuple[float, float, float]:
    """Means of luminance, contrast-structure and their product over sliding windows."""
    wa, wb = _windows(a, size), _windows(b, size)
    ma, mb = wa.mean((-1, -2)), wb.mean((-1, -2))
    va, vb = wa.var((-1, -2)), wb.var((-1, -2))
    cov = (wa * wb).mean((-1, -2)) - ma * mb
    light = (2 * ma * mb + C1) / (ma**2 + mb**2 + C1)
    structure = (2 * cov + C2) / (va + vb + C2)
    return float(light.mean()), float(structure.mean()), float((light * structure).mean())


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    return ssim_parts(a, b)[2]


def halved(a: np.ndarray) -> np.ndarray:
    """2 x 2 means."""
    h, w = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
    return a[:h, :w].reshape(h // 2, 2, w // 2, 2).mean((1, 3))


def ms_ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Product over scales of contrast-structure to the scale's weight, the last one of SSIM."""
    value = 1.0
    for k, weight in enumerate(SCALES):
        _, structure, whole = ssim_parts(a, b)
        last = k == len(SCALES) - 1 or min(a.shape) < 2 * 8
        value *= max(whole if last else structure, 0.0) ** (sum(SCALES[k:]) if last else weight)
        if last:
            break
        a, b = halved(a), halved(b)
    return value


def sobel(a: np.ndarray) -> np.ndarray:
    """Gradient magnitude of the inner samples."""
    if min(a.shape) < 3:
        return np.zeros((0, 0))
    x = (a[:-2, 2:] + 2 * a[1:-1, 2:] + a[2:, 2:]) - (a[:-2, :-2] + 2 * a[1:-1, :-2] + a[2:, :-2])
    y = (a[2:, :-2] + 2 * a[2:, 1:-1] + a[2:, 2:]) - (a[:-2, :-2] + 2 * a[:-2, 1:-1] + a[:-2, 2:])
    return np.hypot(x, y)


def average_hash(a: np.ndarray) -> int:
    """64 bits: which of 8 x 8 cells are brighter than their mean, as a signed long."""
    rows = [np.array_split(band, 8, axis=1) for band in np.array_split(a, 8, axis=0)]
    cells = np.array([[c.mean() if c.size else 0.0 for c in row] for row in rows]).ravel()
    bits = int("".join("1" if x else "0" for x in cells > cells.mean()), 2)
    return bits - (1 << 64) if bits >> 63 else bits


def combined_quality(psnr_value: float, ssim_value: float, vif: float, dlm: float) -> float:
    """Weighted mean in percent of the parts; motion plays no part, so the weights sum to 1."""
    of_psnr = 1.0 if np.isinf(psnr_value) else min(max((psnr_value - 20) / 30, 0.0), 1.0)
    return 100 * (0.45 * vif + 0.35 * dlm + 0.15 * ssim_value + 0.05 * of_psnr)


def information_fidelity(a: np.ndarray, b: np.ndarray, size: int = 8, noise: float = 2.0) -> float:
    """Share of the reference's local information that the other picture keeps, within 0 to 1."""
    wa, wb = _windows(a, size), _windows(b, size)
    va, vb = wa.var((-1, -2)), wb.var((-1, -2))
    cov = (wa * wb).mean((-1, -2)) - wa.mean((-1, -2)) * wb.mean((-1, -2))
    g = np.where(va > 1e-10, cov / np.maximum(va, 1e-10), 0.0)
    rest = np.maximum(vb - g * cov, 0.0)
    whole = np.log2(1 + va / noise).sum()
    kept = np.log2(1 + g**2 * va / (rest + noise)).sum()
    return float(min(max(kept / whole, 0.0), 1.0)) if whole > 0 else 1.0


def detail_kept(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the reference's gradients that the other picture keeps, within 0 to 1."""
    ga, gb = sobel(a), sobel(b)
    whole = ga.sum()
    return float(min(np.minimum(ga, gb).sum() / whole, 1.0)) if whole > 0 else 1.0


def motion_field(a: np.ndarray, b: np.ndarray, block: int, reach: int) -> list[tuple[int, int]]:
    """For each block of a the shift (dx, dy) within reach that fits b best; ties: the smallest shift."""
    shifts = sorted(((dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)), key=lambda s: (abs(s[0]) + abs(s[1]), s))
    field = []
    for y in range(0, a.shape[0] - block + 1, block):
        for x in range(0, a.shape[1] - block + 1, block):
            own, best = a[y : y + block, x : x + block], None
            for dx, dy in shifts:
                yy, xx = y + dy, x + dx
                if 0 <= yy <= b.shape[0] - block and 0 <= xx <= b.shape[1] - block:
                    apart = np.abs(own - b[yy : yy + block, xx : xx + block]).sum()
                    if best is None or apart < best[0]:
                        best = (apart, dx, dy)
            field.append(best[1:])
    return field


def bilateral(a: np.ndarray, sigma_space: float, sigma_range: float, reach: int = 2) -> np.ndarray:
    padded = np.pad(a, reach, mode="edge")
    total, weights = np.zeros_like(a), np.zeros_like(a)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            near = padded[reach + dy : reach + dy + a.shape[0], reach + dx : reach + dx + a.shape[1]]
            w = np.exp(-(dx * dx + dy * dy) / (2 * sigma_space**2) - (near - a) ** 2 / (2 * sigma_range**2))
            total += w * near
            weights += w
    return total / weights


def unsharp(a: np.ndarray, amount: float) -> np.ndarray:
    padded = np.pad(a, 1, mode="edge")
    blurred = sum(padded[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) / 9
    return np.clip(a + amount * (a - blurred), 0, 255)


def scaled(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, sample centres aligned."""
    y = np.clip((np.arange(height) + 0.5) * a.shape[0] / height - 0.5, 0, a.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * a.shape[1] / width - 0.5, 0, a.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    return (a[np.ix_(y0, x0)] * (1 - fx) + a[np.ix_(y0, x1)] * fx) * (1 - fy) + (a[np.ix_(y1, x0)] * (1 - fx) + a[np.ix_(y1, x1)] * fx) * fy


def resampled(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear resampling of a signal."""
    n = int(len(x) * target / source)
    return np.interp(np.arange(n) * source / target, np.arange(len(x)), x) if len(x) else x


def spectrum(x: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.rfft(x))


def deinterlaced(a: np.ndarray, keep_top: bool = True) -> np.ndarray:
    """Rows of one field, the others the mean of their neighbours."""
    out, first = a.astype(float).copy(), 1 if keep_top else 0
    for y in range(first, a.shape[0], 2):
        above, below = a[max(y - 1, 0)] if y else a[1], a[y + 1] if y + 1 < a.shape[0] else a[y - 1]
        out[y] = (above + below) / 2
    return out


def edge_directed(cur: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None, keep_top: bool = True, spatial: bool = True) -> np.ndarray:
    """Rows of one field, the others from the frames before and after or along edges within the frame.

    Samples are whole numbers. A missing neighbour frame counts as this frame. A
    sample follows time (the rounded mean of both neighbours, held within those
    around it) unless the mean of the rows next to it is farther from the spatial
    guess than anything has moved. The spatial guess is the rounded mean of two
    samples two rows up and down, on the line through the place (straight or either
    diagonal) whose ends are nearest; straight wins ties, then the right diagonal.
    """
    c = np.asarray(cur, np.int64)
    h, w = c.shape
    p, n = (c if x is None else np.asarray(x, np.int64) for x in (before, after))
    y, left, right = np.arange(h), np.maximum(np.arange(w) - 1, 0), np.minimum(np.arange(w) + 1, w - 1)
    time = (p + n + 1) >> 1
    guess = time
    if spatial:
        far = c[np.where(y >= 2, y - 2, 0 if keep_top else 1)], c[np.where(y + 2 < h, y + 2, h - 1 if keep_top else h - 2)]
        lines = [(far[0], far[1]), (far[0][:, right], far[1][:, left]), (far[0][:, left], far[1][:, right])]
        best = np.argmin([abs(a - b) for a, b in lines], axis=0)
        inner = np.choose(best, [(a + b + 1) >> 1 for a, b in lines])
        d, e = c[np.maximum(y - 1, 0)], c[np.minimum(y + 1, h - 1)]
        moved = np.maximum.reduce([abs(d - p), abs(e - n), abs(c - time)])
        held = np.clip(time, np.minimum.reduce([d, e, p, n]), np.maximum.reduce([d, e, p, n]))
        guess = np.where(abs((d + e) // 2 - inner) > moved, inner, held)
    kept = (y % 2 == 0) == keep_top
    return np.where(kept[:, None], c, guess)


def picture_kernel(kernel, kind: str = "array<double>"):
    """A Column function (pictures..., width) -> array of a numpy function of pictures; a null picture gives null."""

    @F.pandas_udf(kind)
    def own(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns, strict=True)
        return pd.Series([None if any(x is None for x in r[:-1]) else np.asarray(kernel(*[picture(x, r[-1]) for x in r[:-1]])).ravel().tolist() for r in rows])

    return own


def pair_metric(metric, width_places: int = 2):
    """A Column function (reference, distorted, width) -> double of a numpy metric of two pictures."""

    @F.pandas_udf("double")
    def own(a: pd.Series, b: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else metric(picture(x, w), picture(y, w)) for x, y, w in zip(a, b, width, strict=True)])

    return own


def vmaf_like(a: np.ndarray, b: np.ndarray) -> float:
    error = float(((a - b) ** 2).mean())
    psnr_value = np.inf if error == 0 else 10 * np.log10(255**2 / error)
    return combined_quality(psnr_value, ssim(a, b), information_fidelity(a, b), detail_kept(a, b))


def frame_features():
    """A Column function (data, width) -> struct(luma, edge, hash, histogram)."""

    @F.pandas_udf("luma double, edge double, hash long, histogram array<long>")
    def own(data: pd.Series, width: pd.Series) -> pd.DataFrame:
        rows = []
        for x, w in zip(data, width, strict=True):
            a = picture(x, w)
            edges = sobel(a)
            rows.append((float(a.mean()), float(edges.mean()) if edges.size else 0.0, average_hash(a), np.bincount(np.clip(a, 0, 255).astype(int).ravel(), minlength=256).tolist()))
        return pd.DataFrame(rows, columns=["luma", "edge", "hash", "histogram"])

    return own


def tiles(a: np.ndarray, size: int, overlap: int) -> list[tuple[int, int, np.ndarray]]:
    """(x, y, tile) of a picture; the last tiles are moved in so that none sticks out."""
    step, h, w = size - overlap, *a.shape
    starts = lambda n: [min(k * step, max(n - size, 0)) for k in range(max(1, -(-max(n - overlap, 1) // step)))]
    return [(x, y, a[y : y + size, x : x + size]) for y in starts(h) for x in starts(w)]


def merged_tiles(parts: list[tuple[int, int, np.ndarray]], width: int, height: int, overlap: int) -> np.ndarray:
    """The picture of its tiles; where they overlap they are weighted by the distance from their edges."""
    total, weights = np.zeros((height, width)), np.zeros((height, width))
    for x, y, tile in parts:
        rise = lambda n: np.minimum(1.0, (np.minimum(np.arange(n), np.arange(n)[::-1]) + 1) / (overlap + 1))
        w = np.outer(rise(tile.shape[0]), rise(tile.shape[1]))
        total[y : y + tile.shape[0], x : x + tile.shape[1]] += tile * w
        weights[y : y + tile.shape[0], x : x + tile.shape[1]] += w
    return total / np.where(weights > 0, weights, 1)
