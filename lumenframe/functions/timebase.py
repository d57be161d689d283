"""Exact time-base arithmetic, timecodes and timestamp texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An invalid timestamp.
NO_TIMESTAMP = -(2**63)

#: Nominal frames a second, frames dropped a minute; fixed values of the SMPTE rates.
DROP_FRAME = {"29.97": (30, 2), "59.94": (60, 4)}


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone (in the session's, UTC here)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def rescale(value: Column, num: int, den: int, to_num: int, to_den: int) -> Column:
    """value x (num/den) / (to_num/to_den), exact and truncated towards zero; null stays null.

    Factors whose product with a 64-bit value passes 38 digits are refused.
    """
    up, down = num * to_den, den * to_num
    if down == 0 or abs(up) >= 10**19 or abs(down) >= 10**19:
        raise ValueError("time bases out of range")
    if down < 0:
        up, down = -up, -down
    return F.call_function("div", _wide(value) * F.lit(up).cast("decimal(19,0)"), F.lit(down).cast("decimal(19,0)")).cast("long")


def to_seconds(value: Column, num: int, den: int) -> Column:
    """Seconds as double; null for null and for the invalid timestamp."""
    return F.nullif(value, F.lit(NO_TIMESTAMP)).cast("double") * num / den


def from_seconds(seconds: Column, num: int, den: int) -> Column:
    """Ticks, truncated."""
    return (seconds / (num / den)).cast("long")


def comparable(value: Column, num: int, den: int, finest_num: int, finest_den: int) -> Column:
    """A sort key in the finer time base; invalid timestamps sort first and equal each other."""
    return F.coalesce(rescale(F.nullif(value, F.lit(NO_TIMESTAMP)), num, den, finest_num, finest_den), F.lit(NO_TIMESTAMP))


def _fields(frame: Column, fps: int) -> list[Column]:
    whole = F.call_function("div", frame, F.lit(fps))
    return [F.call_function("div", whole, F.lit(3600)) % 24, F.call_function("div", whole, F.lit(60)) % 60, whole % 60, frame % fps]


def timecode(frame: Column, fps: int) -> Column:
    """Non-drop timecode HH:MM:SS:FF; hours wrap at 24."""
    return F.format_string("%02d:%02d:%02d:%02d", *_fields(frame, fps))


def drop_frame_number(frame: Column, rate: str) -> Column:
    """The frame count that a non-drop clock would show: dropped numbers are added."""
    fps, dropped = DROP_FRAME[rate]
    minute = fps * 60 - dropped
    ten = minute * 10 + dropped
    tens, rest = F.call_function("div", frame, F.lit(ten)), frame % ten
    inside = F.when(rest >= fps * 60, (1 + F.call_function("div", rest - fps * 60, F.lit(minute))) * dropped).otherwise(0)
    return frame + tens * 9 * dropped + inside


def drop_frame_timecode(frame: Column, rate: str) -> Column:
    """Drop-frame timecode HH:MM:SS;FF."""
    return F.format_string("%02d:%02d:%02d;%02d", *_fields(drop_frame_number(frame, rate), DROP_FRAME[rate][0]))


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("long")


TIMECODE = r"^(\d+)[:;](\d+)[:;](\d+)[:;](\d+)$"


def timecode_to_frame(text: Column, fps: int) -> Column:
    """Frame of a non-drop timecode; null if it is none."""
    h, m, s, f = (_part(text, TIMECODE, k) for k in (1, 2, 3, 4))
    return (h * 3600 + m * 60 + s) * fps + f


def add_frames(text: Column, frames: Column, fps: int) -> Column:
    """A non-drop timecode moved by frames, which may be negative; null before 0."""
    moved = timecode_to_frame(text, fps) + frames
    return F.when(moved >= 0, timecode(moved, fps))


def drop_frame_to_frame(text: Column, rate: str) -> Column:
    fps, dropped = DROP_FRAME[rate]
    minutes = _part(text, TIMECODE, 1) * 60 + _part(text, TIMECODE, 2)
    return timecode_to_frame(text, fps) - dropped * (minutes - F.call_function("div", minutes, F.lit(10)))


def is_dropped_frame(minutes: Column, seconds: Column, frames: Column, rate: str) -> Column:
    """Whether the number is skipped: the first of each minute but every tenth."""
    return (minutes % 10 != 0) & (seconds == 0) & (frames < DROP_FRAME[rate][1])


def frames_dropped_until(hours: Column, minutes: Column, rate: str) -> Column:
    total = hours * 60 + minutes
    return DROP_FRAME[rate][1] * (total - F.call_function("div", total, F.lit(10)))


def timecode_to_seconds(text: Column, fps: float) -> Column:
    h, m, s, f = (_part(text, TIMECODE, k) for k in (1, 2, 3, 4))
    return (h * 3600 + m * 60 + s).cast("double") + f / F.lit(float(fps))


def parse_srt(text: Column) -> Column:
    """HH:MM:SS,mmm (or a dot) to ms; the fraction is a whole number of ms: ',5' is 5."""
    pattern = r"^\s*(\d+):(\d+):(\d+)(?:[,.](\d+))?\s*$"
    h, m, s, ms = (_part(text, pattern, k) for k in (1, 2, 3, 4))
    return h * 3_600_000 + m * 60_000 + s * 1000 + F.coalesce(ms, F.lit(0))


def parse_vtt(text: Column) -> Column:
    """[HH:]MM:SS.mmm to ms."""
    pattern = r"^\s*(?:(\d+):)?(\d+):(\d+)\.(\d+)\s*$"
    h, m, s, ms = (_part(text, pattern, k) for k in (1, 2, 3, 4))
    return F.coalesce(h, F.lit(0)) * 3_600_000 + m * 60_000 + s * 1000 + ms


def parse_ass(text: Column) -> Column:
    """H:MM:SS.cc to ms."""
    pattern = r"^\s*(\d+):(\d+):(\d+)\.(\d+)\s*$"
    h, m, s, cs = (_part(text, pattern, k) for k in (1, 2, 3, 4))
    return h * 3_600_000 + m * 60_000 + s * 1000 + cs * 10


def _clock(ms: Column, mark: str) -> Column:
    d = lambda x, y: F.call_function("div", x, F.lit(y))
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", d(ms, 3_600_000), d(ms, 60_000) % 60, d(ms, 1000) % 60, ms % 1000)


def format_srt(ms: Column) -> Column:
    return _clock(ms, ",")


def format_vtt(ms: Column) -> Column:
    return _clock(ms, ".")


def frame_of(seconds: Column, fps: float) -> Column:
    """Nearest frame, halves away from zero."""
    return F.round(seconds * fps).cast("long")


def time_of(frame: Column, fps: float) -> Column:
    return frame / F.lit(float(fps))


def vitc_check(frame: Column, fps: int, user_bits: Column, drop_frame: Column, color_frame: Column, field_mark: Column) -> Column:
    """Exclusive or of a timecode's digits, eight user groups (a long of nibbles) and the flags 1, 2 and 4."""
    check = F.lit(0).cast("long")
    for part in _fields(frame, fps):
        check = check.bitwiseXOR((part % 10).cast("long")).bitwiseXOR(F.call_function("div", part, F.lit(10)).cast("long"))
    for group in range(8):
        check = check.bitwiseXOR(F.shiftright(user_bits, 4 * group).bitwiseAND(F.lit(15)))
    for flag, value in ((drop_frame, 1), (color_frame, 2), (field_mark, 4)):
        check = check.bitwiseXOR(F.when(flag, value).otherwise(0))
    return check
