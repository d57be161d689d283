"""Operators whose next row depends on earlier decisions.

Streams are spread over the cluster and sorted by Spark; a fold then reads each
stream's rows in order, Arrow batch by Arrow batch, and carries only its state
from one to the next, so a stream of any length takes bounded memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Generator, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

#: A fold is sent the chunks of one stream in order, and None at its end; it yields what each lets out.
Fold = Generator[pa.RecordBatch | None, pa.RecordBatch | None, None]


def _schema(df: DataFrame, columns: Sequence[str], more: str = "") -> str:
    types = dict(df.dtypes)
    return ", ".join([f"`{c}` {types[c]}" for c in columns] + ([more] if more else []))


def _streams(batches: Iterator[pa.RecordBatch], by: Sequence[str], fold: Callable[[], Fold]) -> Iterator[pa.RecordBatch]:
    """Runs a fold of its own over each run of rows that agree in `by`."""
    key, own = None, None
    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in by], strict=True))
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if own is None or keys[at] != key:
                if own is not None and (out := own.send(None)) is not None:
                    yield out
                key, own = keys[at], fold()
                next(own)
            if (out := own.send(batch.slice(at, end - at))) is not None:
                yield out
            at = end
    if own is not None and (out := own.send(None)) is not None:
        yield out


def folded(df: DataFrame, by: Sequence[str], order: Sequence[str], fold: Callable[[], Fold], schema: str) -> DataFrame:
    """What the fold lets out of each stream's rows, in their order."""
    ordered = df.repartition(*by).sortWithinPartitions(*by, *order)
    return ordered.mapInArrow(lambda batches: _streams(batches, by, fold), schema)


def keep_spaced(places: Sequence[int], gap: int, last: int | None = None) -> list[bool]:
    """Greedy: a place is kept if it is at least `gap` after the last kept one."""
    kept = []
    for p in places:
        ok = last is None or p - last >= gap
        kept.append(ok)
        if ok:
            last = p
    return kept


def _spaced(chunk: pa.RecordBatch, place: str, gap: int, last: int | None) -> tuple[list[bool], int | None]:
    places = chunk.column(place).to_pylist()
    kept = keep_spaced(places, gap, last)
    return kept, max((p for p, ok in zip(places, kept, strict=True) if ok), default=last)


def cooled_down(alerts: DataFrame, by: Sequence[str], place: str, cooldown: str) -> DataFrame:
    """Alerts of each rule that come at least its cooldown after the last that fired."""

    def fold() -> Fold:
        last, chunk = None, (yield None)
        while chunk is not None:
            kept, last = _spaced(chunk, place, int(chunk.column(cooldown)[0].as_py()), last)
            chunk = yield chunk.filter(pa.array(kept))

    return folded(alerts, by, [place], lambda: _closed(fold()), _schema(alerts, alerts.columns))


def _closed(fold: Fold) -> Fold:
    """A fold that lets nothing out at the end."""
    out = next(fold)
    while True:
        chunk = yield out
        if chunk is None:
            yield None
        out = fold.send(chunk)


def spaced_cuts(df: DataFrame, by: Sequence[str], place: str, candidate: str, gap: int) -> DataFrame:
    """df with `cut`: candidates at least `gap` after the last accepted one, which is 0 at first."""

    def fold() -> Fold:
        last, chunk = 0, (yield None)
        while chunk is not None:
            cut = []
            for p, wanted in zip(chunk.column(place).to_pylist(), chunk.column(candidate).to_pylist(), strict=True):
                cut.append(bool(wanted) and p - last >= gap)
                last = p if cut[-1] else last
            chunk = yield chunk.append_column("cut", pa.array(cut, pa.bool_()))

    return folded(df, by, [place], lambda: _closed(fold()), _schema(df, df.columns, "cut boolean"))


def merging(cues: Iterator[dict], min_ms: int, gap_ms: int) -> Iterator[dict]:
    """Cues of which neighbours are joined if one is shorter than min_ms and they are within gap_ms.

    A joined cue is held back to be looked at with the next. Confidence is
    averaged pair by pair.
    """
    held: dict | None = None
    for cue in cues:
        if held is None:
            held = dict(cue)
            continue
        shortest = min(c["end_ms"] - c["start_ms"] for c in (held, cue))
        if shortest < min_ms and max(cue["start_ms"] - held["end_ms"], 0) <= gap_ms:
            held |= {"text": f"{held['text']} {cue['text']}", "end_ms": cue["end_ms"], "confidence": (held["confidence"] + cue["confidence"]) / 2}
        else:
            yield held
            held = dict(cue)
    if held is not None:
        yield held


def merge_short(cues: list[dict], min_ms: int, gap_ms: int) -> list[dict]:
    return list(merging(iter(cues), min_ms, gap_ms))


def split_long(cues: list[dict], max_ms: int, max_bytes: int) -> list[dict]:
    """Cues too long in time or bytes give their first half of words, in half their time, until the rest fits.

    A cue of one word stays.
    """

    def parts(start: int, end: int, text: str) -> Iterator[tuple[int, int, str]]:
        words = text.split()
        while len(words) > 1 and (end - start > max_ms or len(text.encode()) > max_bytes):
            taken, middle = len(words) // 2, start + (end - start) // 2
            yield start, middle, " ".join(words[:taken])
            start, words = middle, words[taken:]
            text = " ".join(words)
        yield start, end, text

    return [{**cue, "start_ms": a, "end_ms": b, "text": t} for cue in cues for a, b, t in parts(cue["start_ms"], cue["end_ms"], cue["text"])]


def _cue_fold(df: DataFrame, doc: str, order: str, rows: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """Applies a transform of cue iterators document by document; idx is numbered anew.

    Cues go through one by one; the transform sees a cue once those before it are done.
    """
    fields = ["start_ms", "end_ms", "text", "confidence"]
    schema = f"`{doc}` {dict(df.dtypes)[doc]}, idx int, start_ms long, end_ms long, text string, confidence double"

    def streamed(batches):
        def cues():
            for batch in batches:
                yield from batch.to_pylist()

        def whole(first: dict, rest: Iterator[dict], left: list):
            yield first
            for cue in rest:
                if cue[doc] != first[doc]:
                    left.append(cue)
                    return
                yield cue

        incoming, left, out, names = cues(), [], [], [doc, "idx", *fields]
        while (first := left.pop() if left else next(incoming, None)) is not None:
            for i, cue in enumerate(rows(whole(first, incoming, left))):
                out.append({doc: first[doc], "idx": i, **{f: cue[f] for f in fields}})
                if len(out) == 4096:
                    yield pa.RecordBatch.from_pylist(out, types)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, types)

    from pyspark.sql.pandas.types import to_arrow_schema

    own = df.select(doc, order, *fields).selectExpr(f"`{doc}`", f"`{order}`", "cast(start_ms as long) start_ms", "cast(end_ms as long) end_ms", "text", "cast(confidence as double) confidence")
    types = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return own.repartition(doc).sortWithinPartitions(doc, order).mapInArrow(streamed, schema)


def merged_cues(df: DataFrame, doc: str, order: str, min_ms: int, gap_ms: int) -> DataFrame:
    return _cue_fold(df, doc, order, lambda cues: merging(cues, min_ms, gap_ms))


def split_cues(df: DataFrame, doc: str, order: str, max_ms: int, max_bytes: int) -> DataFrame:
    return _cue_fold(df, doc, order, lambda cues: (part for cue in cues for part in split_long([cue], max_ms, max_bytes)))


class Reorder:
    """Rows by sequence number out of a stream that is only nearly in order.

    A heap holds at most `limit` rows that came too early. Rows before the
    expected number, and early ones without room, are dropped and counted. A row
    more than `limit` ahead gives the gap up: all that is held comes out, and the
    number after it is expected next.
    """

    def __init__(self, limit: int, expected: int | None = 0, held: list | None = None):
        self.limit, self.expected, self.held, self.dropped = limit, expected, held or [], 0
        self.taken = 1 + max((item[1] for item in self.held), default=-1)

    def push(self, seq: int, row) -> list:
        ahead = 0 if self.expected is None else seq - self.expected
        if ahead == 0:
            self.expected = seq + 1
            return [row, *self._following()]
        room = len(self.held) < self.limit
        if ahead < 0 or not room:
            self.dropped += 1
        else:
            heapq.heappush(self.held, (seq, self.taken, row))
            self.taken += 1
        if ahead <= self.limit:
            return []
        self.expected = seq + 1
        return self.flush()

    def _following(self) -> Iterator:
        """Held rows that continue the sequence; of rows of one number the first, the others stay."""
        passed = []
        while self.held and self.held[0][0] <= self.expected:
            item = heapq.heappop(self.held)
            if item[0] == self.expected:
                self.expected += 1
                yield item[2]
            else:
                passed.append(item)
        for item in passed:
            heapq.heappush(self.held, item)

    def flush(self) -> list:
        out, self.held = [item[2] for item in sorted(self.held, key=lambda item: item[:2])], []
        return out


class Jitter:
    """Rows in order of time out of a buffer that is kept `depth` deep.

    A row comes out, the earliest first, while the buffer spans at least `depth`.
    Beyond `limit` rows the earliest are dropped.
    """

    def __init__(self, depth: int, limit: int, held: list | None = None, taken: int = 0):
        self.depth, self.limit, self.held, self.taken, self.dropped = depth, limit, held or [], taken, 0
        self.latest = max((item[0] for item in self.held), default=None)

    def push(self, at: int, row) -> list:
        heapq.heappush(self.held, (at, self.taken, row))
        self.taken += 1
        self.latest = at if self.latest is None else max(self.latest, at)
        while len(self.held) > self.limit:
            heapq.heappop(self.held)
            self.dropped += 1
        out = []
        while len(self.held) > 1 and self.latest - self.held[0][0] >= self.depth:
            out.append(heapq.heappop(self.held)[2])
        return out

    def flush(self) -> list:
        return [heapq.heappop(self.held)[2] for _ in range(len(self.held))]


def _released(df: DataFrame, by: Sequence[str], arrival: str, place: str, buffer: Callable[[], Reorder | Jitter]) -> DataFrame:
    """The rows that a buffer lets out, with their place `released`; what it holds comes out at the end."""

    def fold() -> Fold:
        own, n, chunk = buffer(), 0, (yield None)
        types = None if chunk is None else pa.schema([*chunk.schema, pa.field("released", pa.int64())])
        while True:
            rows = own.flush() if chunk is None else [out for row in chunk.to_pylist() for out in own.push(row[place], row)]
            made = [{**row, "released": n + i} for i, row in enumerate(rows)]
            n += len(rows)
            chunk = yield pa.RecordBatch.from_pylist(made, types)

    return folded(df, by, [arrival], fold, _schema(df, df.columns, "released long"))


def reordered(df: DataFrame, by: Sequence[str], arrival: str, seq: str, limit: int) -> DataFrame:
    """The rows that Reorder lets out, with their place `released`, by stream in order of arrival; null numbers are an error."""
    return _released(df, by, arrival, seq, lambda: Reorder(limit, None))


def jitter_buffered(df: DataFrame, by: Sequence[str], arrival: str, at: str, depth: int, limit: int) -> DataFrame:
    """The rows that Jitter lets out, with their place `released`, by stream in order of arrival; `at` is a whole number."""
    return _released(df, by, arrival, at, lambda: Jitter(depth, limit))


class Breaker:
    """A circuit breaker's state after each call (time, success).

    Closed, it opens at `failures` failures since the last success. A call at
    least `open_for` after that finds it half open; earlier ones change nothing.
    `successes` calls that succeed close it, one that fails opens it again.
    """

    def __init__(self, failures: int, successes: int, open_for: int):
        self.failures, self.successes, self.open_for = failures, successes, open_for
        self.state, self.run, self.since = "closed", 0, 0

    def _become(self, state: str, at: int) -> None:
        self.state, self.run = state, 0
        self.since = at if state == "open" else self.since

    def call(self, at: int, ok: bool) -> str:
        if self.state == "open" and at - self.since >= self.open_for:
            self._become("half_open", at)
        if self.state == "closed":
            self.run = 0 if ok else self.run + 1
            if self.run >= self.failures:
                self._become("open", at)
        elif self.state == "half_open" and not ok:
            self._become("open", at)
        elif self.state == "half_open":
            self.run += 1
            if self.run >= self.successes:
                self._become("closed", at)
        return self.state


def breaker_states(calls: Sequence[tuple[int, bool]], failures: int, successes: int, open_for: int) -> list[str]:
    own = Breaker(failures, successes, open_for)
    return [own.call(at, ok) for at, ok in calls]


def circuit_breaker(df: DataFrame, by: Sequence[str], at: str, ok: str, failures: int, successes: int, open_for: int) -> DataFrame:
    """df with the breaker's state after each call; `at` is its time as a whole number."""

    def fold() -> Fold:
        own, chunk = Breaker(failures, successes, open_for), (yield None)
        while chunk is not None:
            states = [own.call(t, good) for t, good in zip(chunk.column(at).to_pylist(), chunk.column(ok).to_pylist(), strict=True)]
            chunk = yield chunk.append_column("breaker", pa.array(states))

    return folded(df, by, [at], lambda: _closed(fold()), _schema(df, df.columns, "breaker string"))


def kept_rungs(df: DataFrame, by: Sequence[str], order: Sequence[str], kbps: str, vmaf: str, gap: int, low: float) -> DataFrame:
    """Rungs from the highest down, at least `gap` kbit/s below the last one kept and of at least `low` quality.

    A rung that is not below the last kept one counts as no gap.
    """

    def fold() -> Fold:
        last, chunk = None, (yield None)
        while chunk is not None:
            kept = []
            for rate, quality in zip(chunk.column(kbps).to_pylist(), chunk.column(vmaf).to_pylist(), strict=True):
                kept.append((last is None or max(last - rate, 0) >= gap) and quality >= low)
                last = rate if kept[-1] else last
            chunk = yield chunk.filter(pa.array(kept, pa.bool_()))

    return folded(df, by, order, lambda: _closed(fold()), _schema(df, df.columns))
