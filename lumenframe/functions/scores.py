"""Scores, levels and ratings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS_INF = float("-inf")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def linear_to_db(x: Column) -> Column:
    """20 log10; minus infinity at 0 and below."""
    return F.when(x > 0, 20 * F.log10(x)).when(x.isNotNull(), F.lit(MINUS_INF))


def power_to_lufs(x: Column) -> Column:
    return F.when(x > 0, -0.691 + 10 * F.log10(x)).when(x.isNotNull(), F.lit(MINUS_INF))


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def profile_complexity(spatial: Column, temporal: Column, motion: Column, grain: Column) -> Column:
    """Weighted sum in this order (a changed order may change a class), within 0 to 1."""
    return clamp(spatial * 0.35 + temporal * 0.30 + motion * 0.20 + grain * 0.15, 0, 1)


def profile_class(score: Column) -> Column:
    return F.when(score < 0.25, "Simple").when(score < 0.5, "Moderate").when(score < 0.75, "Complex").otherwise("Extreme")


def overall_quality(psnr: Column, ssim: Column, vmaf: Column) -> Column:
    """VMAF, else SSIM in percent, else PSNR from 20 to 50 dB in percent (infinite: 100), else 0."""
    of_psnr = F.when(psnr == float("inf"), 100.0).otherwise(clamp((psnr - 20) / 30 * 100, 0, 100))
    return F.coalesce(vmaf, ssim * 100, F.when(psnr.isNotNull(), of_psnr), F.lit(0.0))


def quality_rating(score: Column) -> Column:
    return F.when(score >= 93, "Excellent").when(score >= 80, "Good").when(score >= 60, "Fair").otherwise("Poor")


def worker_load(cpu: Column, memory: Column, tasks: Column) -> Column:
    return cpu * 0.4 + memory * 0.3 + F.least(tasks / 4, F.lit(1.0)) * 0.3


def predicted_vmaf(bits_per_pixel: Column, complexity: Column, scale: Column) -> Column:
    return clamp(100 * (1 - F.exp(-500 * bits_per_pixel)) - 10 * complexity - 5 * (1 - scale), 0, 100)


def preset(complexity: Column) -> Column:
    return F.when(complexity > 70, "Slow").when(complexity > 40, "Medium").otherwise("Fast")


def resolution_category(width: Column, height: Column) -> Column:
    pixels = width.cast("long") * height
    return F.when(pixels >= 3840 * 2160, "Uhd4K").when(pixels >= 1920 * 1080, "Fhd1080P").when(pixels >= 1280 * 720, "Hd720P").when(pixels >= 854 * 480, "Sd480P").otherwise("Low")


def pq_eotf(e: Column) -> Column:
    """Nits of a PQ signal; the constants are those of SMPTE ST 2084, fixed values."""
    m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 32, 3424 / 4096, 2413 / 128, 2392 / 128
    p = F.pow(clamp(e, 0, 1), F.lit(1 / m2))
    return 10000 * F.pow(F.greatest(p - c1, F.lit(0.0)) / (c2 - c3 * p), F.lit(1 / m1))


#: Frame rates with a name, and the conversions between them that are not a blend; fixed values.
FILM, NTSC_FILM, PAL, NTSC, WEB = 24.0, 24000 / 1001, 25.0, 30000 / 1001, 30.0
STANDARD_RATES = (FILM, NTSC_FILM, PAL, NTSC, WEB, 50.0, 60000 / 1001, 60.0)
NAMED_CONVERSIONS = {
    "Telecine": [(a, b) for a in (FILM, NTSC_FILM) for b in (NTSC, WEB)],
    "InverseTelecine": [(a, b) for a in (NTSC, WEB) for b in (FILM, NTSC_FILM)],
    "SpeedChange": [(FILM, PAL), (PAL, FILM)],
}


def suggested_conversion(source: Column, target: Column) -> Column:
    """How to change a frame rate.

    Between standard rates by name, the same rate by dropping, others by
    blending; else nearly equal rates by dropping, ratios from 0.67 to 1.5 by
    blending and others by motion compensation.
    """
    near = lambda c, rate: F.abs(c - rate) < 0.001
    standard = lambda c: F.exists(F.array(*[F.lit(r) for r in STANDARD_RATES]), lambda r: F.abs(c - r) < 0.001)
    both, ratio = standard(source) & standard(target), target / source
    chain = F.when(both & (F.abs(source - target) < 0.001), "DropDuplicate")
    for method, pairs in NAMED_CONVERSIONS.items():
        for a, b in pairs:
            chain = chain.when(near(source, a) & near(target, b), method)
    return chain.when(both, "Blend").when(F.abs(ratio - 1) < 0.001, "DropDuplicate").when(~ratio.between(0.67, 1.5), "MotionCompensated").otherwise("Blend")


def scaling_target(pending: Column, active: Column, replicas: Column, low: int = 1, high: int = 20, per_worker: int = 2, up: float = 0.8, down: float = 0.3) -> Column:
    """Replicas after scaling; the same number where nothing changes.

    Up at a utilisation of `up` or a queue of more than `per_worker` jobs a
    replica, down below `down` with at most half such a queue. Without replicas,
    pending jobs start the least number.
    """
    utilisation, pressure = active / replicas, pending / (replicas * per_worker)
    wanted = F.least(F.greatest(F.ceil(pending / per_worker).cast("int"), replicas + 1), F.lit(high))
    fewer = F.greatest(active + 1, F.lit(low))
    empty = F.when(pending > 0, F.greatest(F.lit(low), F.lit(1))).otherwise(replicas)
    return (
        F.when(replicas == 0, empty)
        .when(((utilisation >= up) | (pressure > 1)) & (wanted > replicas), wanted)
        .when((utilisation < down) & (pressure < 0.5) & (fewer < replicas), fewer)
        .otherwise(replicas)
    )


def predicted_ssim(bits_per_pixel: Column, complexity: Column) -> Column:
    return clamp(1 - F.exp(-300 * bits_per_pixel) - 0.03 * complexity, 0, 1)


#: Bitrate factors of the profile classes; fixed values.
CLASS_FACTORS = {"Simple": 0.65, "Moderate": 1.0, "Complex": 1.40, "Extreme": 1.85}


def bitrate_factor(profile: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CLASS_FACTORS.items() for x in pair]), profile)


def content_complexity(spatial: Column, temporal: Column, motion: Column, detail: Column, grain: Column) -> Column:
    """Weighted sum of content features, within 0 to 1."""
    return clamp(spatial * 0.3 + temporal * 0.3 + motion * 0.15 + detail * 0.15 + grain * 0.1, 0, 1)


def scene_type(motion: Column, temporal: Column, edges: Column, spatial: Column, texture: Column, color: Column) -> Column:
    """struct(type, confidence) by the first rule that holds."""
    kind = lambda name, sure: F.struct(F.lit(name).alias("type"), F.lit(sure).alias("confidence"))
    return (
        F.when((motion < 0.1) & (temporal < 0.1), kind("Static", 0.9))
        .when(motion > 0.7, kind("Action", 0.8))
        .when((edges > 0.8) & (spatial < 0.3), kind("Graphics", 0.7))
        .when((texture > 0.6) & (color > 0.6), kind("Nature", 0.6))
        .when((motion < 0.3) & (spatial < 0.4), kind("TalkingHead", 0.6))
        .otherwise(kind("Unknown", 0.5))
    )


#: CRF adjustments of the scene types; fixed values.
CRF_ADJUSTMENTS = {"Static": 2, "TalkingHead": 1, "Action": -2, "Nature": 0, "Animation": 1, "Sports": -2, "Graphics": -1, "Unknown": 0}


def crf_adjustment(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CRF_ADJUSTMENTS.items() for x in pair]), kind)


def content_type(spatial: Column, temporal: Column) -> Column:
    """Kind of content by the first rule that holds."""
    return (
        F.when((spatial < 20) & (temporal < 20), "Animation")
        .when((spatial < 40) & (temporal < 15), "TalkingHead")
        .when(temporal > 60, "Sports")
        .when(spatial > 70, "Nature")
        .when((spatial > 50) & (temporal > 40), "Gaming")
        .when(spatial > 40, "Film")
        .otherwise("Generic")
    )


def audio_type(rms: Column, zero_crossings: Column, centroid: Column, silence: float = 0.01) -> Column:
    """Silence, Speech, Music or Mixed by level, crossings and spectral centroid."""
    speech = ((zero_crossings > 0.05).cast("int") + (centroid < 3000).cast("int")) / 3
    music = ((zero_crossings < 0.1).cast("int") + (centroid > 1000).cast("int")) / 3
    return F.when(rms < silence, "Silence").when(speech > music + 0.2, "Speech").when(music > speech + 0.2, "Music").otherwise("Mixed")


#: Allowed changes of a task's state; fixed values.
TRANSITIONS = {
    "pending": ("queued", "cancelled"),
    "queued": ("running", "cancelled", "pending"),
    "running": ("completed", "failed", "cancelled", "retrying"),
    "failed": ("retrying", "pending"),
    "retrying": ("pending", "cancelled"),
}


def may_follow(state: Column, following: Column) -> Column:
    """Whether a task may go from one state to another."""
    chain = F.lit(False)
    for before, after in TRANSITIONS.items():
        chain = chain | ((state == before) & following.isin(*after))
    return chain


#: Weights of spatial and temporal complexity, motion, detail and grain; fixed values.
COMPLEXITY_WEIGHTS = (0.3, 0.3, 0.15, 0.15, 0.1)


def content_complexity(*parts: Column) -> Column:
    """Weighted mean of spatial and temporal complexity, motion, detail and grain, within 0 to 1."""
    total = sum((p * w for p, w in zip(parts[1:], COMPLEXITY_WEIGHTS[1:], strict=True)), parts[0] * COMPLEXITY_WEIGHTS[0])
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))
