"""Streaming forms of the recurrences: keyed state, Arrow batches, event time.

Each function takes a streaming (or batch) DataFrame and gives one back; sources
and sinks are the caller's. State is kept per stream, so streams are processed
side by side.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenframe.operators.recurrences import Jitter, Reorder
from lumenframe.operators.segments import windowed


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """df with its watermark and __ms, the event time as a number."""
    return df.withWatermark(ts, late).withColumn("__ms", F.unix_millis(F.col(ts).cast("timestamp")))


def _wake_at(state: GroupState, ms: int) -> None:
    """Asks to be called once the watermark has passed ms."""
    state.setTimeoutTimestamp(max(ms, state.getCurrentWatermarkMs() + 1))


def reordered_stream(df: DataFrame, stream: str, seq: str, value: str, limit: int, ts: str, late: str = "0 seconds", idle_ms: int = 10_000) -> DataFrame:
    """(stream, seq, value) let out in order of seq within each stream.

    Rows of one micro-batch are taken in order of `seq` among themselves; a row
    below the expected number is late and dropped. Rows held for a gap come out
    when the gap closes, when it grows beyond `limit`, or when the watermark is
    idle_ms beyond the stream's last row, so a stream that falls silent is whole.
    """
    schema = f"`{stream}` long, `{seq}` long, `{value}` double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, held, last = pickle.loads(state.get[0]) if state.exists else (None, None, 0)
        buffer, out = Reorder(limit, expected, held), []
        if state.hasTimedOut:
            buffer.expected = max(buffer.expected, *(item[0] + 1 for item in buffer.held))
            out = buffer.flush()
        else:
            rows = pd.concat(list(batches)).sort_values(seq, kind="stable")
            last = max(last, int(rows["__ms"].max()))
            for s, v in zip(rows[seq].tolist(), rows[value].tolist(), strict=True):
                out += buffer.push(int(s), (key[0], int(s), v))
        state.update((pickle.dumps((buffer.expected, buffer.held, last)),))
        if buffer.held:
            _wake_at(state, last + idle_ms)
        yield pd.DataFrame(out, columns=[stream, seq, value])

    return _timed(df, ts, late).select(stream, seq, value, ts, "__ms").groupBy(stream).applyInPandasWithState(step, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def cooled_down_stream(alerts: DataFrame, stream: str, rule: str, place: str, cooldown: int) -> DataFrame:
    """Alerts of each stream and rule at least `cooldown` after the last one let out."""
    schema = f"`{stream}` long, `{rule}` string, `{place}` long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for p in sorted(int(x) for b in batches for x in b[place]):
            if last is None or p - last >= cooldown:
                last = p
                out.append((*key, p))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[stream, rule, place])

    return alerts.select(stream, rule, place).groupBy(stream, rule).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def windowed_stream(df: DataFrame, ts: str, seconds: int, late: str, by: list[str], value: str) -> DataFrame:
    """Tumbling counts and sums; rows later than the watermark are dropped."""
    return windowed(df.withWatermark(ts, late), ts, seconds, by, value)


def jitter_released(df: DataFrame, stream: str, ts: str, value: str, depth_ms: int, limit: int, late: str = "0 seconds") -> DataFrame:
    """(stream, at_ms, value) in order of time out of a Jitter buffer a stream.

    What is left in the buffer comes out, in order, once the watermark has passed
    the stream's last row by depth_ms.
    """
    schema = f"`{stream}` long, at_ms long, `{value}` double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = Jitter(depth_ms, limit, *pickle.loads(state.get[0])) if state.exists else Jitter(depth_ms, limit)
        out = buffer.flush() if state.hasTimedOut else []
        for batch in batches:
            for at, v in zip(batch["__ms"].tolist(), batch[value].tolist(), strict=True):
                out += buffer.push(int(at), (key[0], int(at), v))
        state.update((pickle.dumps((buffer.held, buffer.taken)),))
        if buffer.held:
            _wake_at(state, buffer.latest + depth_ms)
        yield pd.DataFrame(out, columns=[stream, "at_ms", value])

    return _timed(df, ts, late).select(stream, value, ts, "__ms").groupBy(stream).applyInPandasWithState(step, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def sync_stream(video: DataFrame, audio: DataFrame, stream: str, max_drift_us: int, late: str) -> DataFrame:
    """(stream, video_us, audio_us): each video row with the latest audio row at or before it, within the drift.

    A video row is matched when the watermark has passed it, as then no earlier
    audio can come; one without audio within the drift is dropped. The state holds
    the video rows to come and the audio rows since the last one matched.
    """
    side = lambda df, ts, kind: df.select(F.col(stream).cast("long").alias(stream), F.col(ts).alias("__ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("__us"), F.lit(kind).alias("__kind"))
    both = side(video, "video_ts", "v").unionByName(side(audio, "audio_ts", "a")).withWatermark("__ts", late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, heard = pickle.loads(state.get[0]) if state.exists else ([], [])
        for batch in batches:
            for us, kind in zip(batch["__us"].tolist(), batch["__kind"].tolist(), strict=True):
                (waiting if kind == "v" else heard).append(int(us))
        waiting, heard, passed, out = sorted(waiting), sorted(heard), state.getCurrentWatermarkMs() * 1000, []
        done = bisect_left(waiting, passed)
        for us in waiting[:done]:
            at = bisect_right(heard, us)
            if at and us - heard[at - 1] <= max_drift_us:
                out.append((key[0], us, heard[at - 1]))
        waiting = waiting[done:]
        heard = heard[max(bisect_right(heard, min([passed, *waiting[:1]])) - 1, 0) :]
        state.update((pickle.dumps((waiting, heard)),))
        if waiting:
            _wake_at(state, waiting[0] // 1000 + 1)
        yield pd.DataFrame(out, columns=[stream, "video_us", "audio_us"])

    return both.groupBy(stream).applyInPandasWithState(step, f"`{stream}` long, video_us long, audio_us long", "state binary", "append", GroupStateTimeout.EventTimeTimeout)
