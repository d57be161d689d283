"""Order-preserving packing of token streams by dynamic programming.

The documents of a partition, in their order, form one stream of ids. Windows
of at most `window` ids are cut from it so that padding plus penalties of cuts
inside documents is least. Cuts stand at ends of documents (free) or sentences
(SENTENCE_PENALTY); only a sentence of more than `window` ids may be cut inside,
every GRID ids (INNER_PENALTY).
With P the ids before a cut, the best cost is
    f(j) = P(j)-free part + min over i, P(j) - window <= P(i), of f(i) + P(i),
whose minimum over a sliding range a monotone queue yields in linear time.
"""

from __future__ import annotations

import struct
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import only, worker_cache
from lumenframe.session import table

WINDOW = 2048
#: Cost of a cut in ids of padding.
SENTENCE_PENALTY, INNER_PENALTY = 2, 8
#: Inside a sentence longer than the window a cut may stand at every so many of its ids.
GRID = 16
#: Ids that one run of the dynamic programming sees; its last window is cut anew
#: together with what follows, so runs are joined without padding.
RUN_IDS = 1 << 20
#: Closes each document.
END_ID = 1
#: Not padded, as is any power of two.
SPECIAL = "<|endoftext|>"


def _tokenizer(path: str | None):
    """(ids of a text as a numpy array, which ids end a sentence); kept by the worker.

    `tokenizers` is the authority. The same vocabulary runs faster in the other
    library, but for texts that spell a special token, which only `tokenizers`
    knows, and for those whose runs of blanks are too long for its pattern.
    """
    cache = worker_cache()
    if ("packing", path) not in cache:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        ranks_path = path[: -len(".json")] + ".tiktoken" if path else public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        ends = np.zeros(max(ranks.values()) + 2, bool)
        for word, rank in ranks.items():
            ends[rank] = word.endswith((b".", b"!", b"?", b"\n"))

        def ids(text: str) -> np.ndarray:
            if SPECIAL not in text:
                try:
                    return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
                except ValueError:  # the pattern's stack
                    pass
            return np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)

        cache[("packing", path)] = ids, ends
    return cache[("packing", path)]


def best_cuts(positions: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """Cuts of least cost, as indices into positions, from the first to the last.

    positions: ascending, no two more than `window` apart. The cost of a window
    from i to j is window - (positions[j] - positions[i]) plus penalties[j]; the
    last is not charged for padding. Ties go to the earliest cut.
    """
    at, cost = positions.tolist(), penalties.tolist()
    n = len(at)
    came, best = [0] * n, [0] * n
    queue: deque = deque([(at[0], 0)])
    for j in range(1, n):
        low = at[j] - window
        while at[queue[0][1]] < low:
            queue.popleft()
        value, came[j] = queue[0]
        best[j] = value - at[j] + window + cost[j]
        value = best[j] + at[j]
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
    last = n - 1
    i = last - 1
    while i >= 0 and at[i] >= at[last] - window:  # the last window costs nothing of its own
        if i == last - 1 or best[i] <= best[came[last]]:
            came[last] = i
        i -= 1
    cuts, j = [], last
    while j:
        cuts.append(j)
        j = came[j]
    cuts.append(0)
    return cuts[::-1]


def inner_cuts(ends: np.ndarray, window: int) -> np.ndarray:
    """Every GRID ids inside the sentences, given by their ends from 0 on, that are longer than the window."""
    long = np.flatnonzero(np.diff(ends) > window)
    return np.concatenate([np.arange(ends[k] + GRID, ends[k + 1], GRID) for k in long]) if len(long) else np.empty(0, np.int64)


def tail_lengths(length: int, window: int) -> list[int]:
    """A rest shorter than a window as powers of two, longest first: no padding."""
    if length == window:
        return [length]
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


class _Packer:
    """Packs the stream of one partition; yields rows of pieces."""

    def __init__(self, partition: int, window: int, ends: np.ndarray):
        self.window, self.ends, self.sequence = window, ends, partition << 40
        self.docs: list = []  # (doc_id, doc_tokens, ids before the buffer)
        self.parts: list = []
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids) + 1, 0))
        self.parts += [ids, np.array([END_ID], np.uint32)]
        self.held += len(ids) + 1

    def run(self, final: bool) -> dict:
        """Pieces of the windows that are settled; the last stays unless final."""
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, np.uint32)
        lengths = np.array([n - before for _, n, before in self.docs], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        sentence = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
        penalty = np.full(len(ids) + 1, -1, np.int32)
        penalty[sentence] = SENTENCE_PENALTY
        penalty[starts] = 0
        penalty[inner_cuts(np.flatnonzero(penalty >= 0), self.window)] = INNER_PENALTY
        positions = np.flatnonzero(penalty >= 0)
        cuts = positions[best_cuts(positions, penalty[positions], self.window)] if len(ids) else np.zeros(1, np.int64)
        if final:
            whole, rest = cuts[:-1], tail_lengths(int(cuts[-1] - cuts[-2]), self.window) if len(cuts) > 1 else []
            if rest:
                cuts = np.concatenate([whole, whole[-1] + np.cumsum(rest)])
        else:
            cuts = cuts[:-1]
        rows = self._pieces(ids, starts, cuts)
        done = int(cuts[-1])
        first = int(np.searchsorted(starts, done, "right")) - 1
        self.docs = [(d, n, before + max(0, done - int(starts[k]))) for k, (d, n, before) in enumerate(self.docs[first:], first)]
        self.parts, self.held = [ids[done:].copy()], len(ids) - done
        return rows

    def _pieces(self, ids: np.ndarray, starts: np.ndarray, cuts: np.ndarray) -> dict:
        bounds = np.union1d(starts[starts <= cuts[-1]], cuts)
        left, right = bounds[:-1], bounds[1:]
        doc = np.searchsorted(starts, left, "right") - 1
        sequence = np.searchsorted(cuts, left, "right") - 1
        doc_ids, totals, before = zip(*self.docs, strict=True) if self.docs else ((), (), ())
        pick = doc.tolist()
        raw = ids.astype("<u4").tobytes()
        rows = {
            "doc_id": pa.array([doc_ids[k] for k in pick], pa.int64()),
            "start": pa.array(np.array(before, np.int64)[doc] + left - starts[doc] if pick else [], pa.int64()),
            "length": pa.array(right - left, pa.int64()),
            "doc_tokens": pa.array([totals[k] for k in pick], pa.int64()),
            "sequence_id": pa.array(self.sequence + sequence, pa.int64()),
            "offset": pa.array(left - cuts[sequence] if pick else [], pa.int64()),
            "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(left.tolist(), right.tolist(), strict=True)], pa.binary()),
        }
        self.sequence += len(cuts) - 1
        return rows


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pack_partition(window: int, tokenizer_path: str | None):
    def pack(batches):
        from pyspark import TaskContext

        encode, ends = _tokenizer(tokenizer_path)
        packer = _Packer(TaskContext.get().partitionId(), window, ends)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, encode(text.as_py() or ""))
                if packer.held >= RUN_IDS:
                    yield pa.RecordBatch.from_pydict(packer.run(final=False))
        if packer.held:
            yield pa.RecordBatch.from_pydict(packer.run(final=True))

    return pack


def pack_documents(docs: DataFrame, window: int = WINDOW, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces of documents in sequences of at most `window` ids.

    A document is its text's ids, then END_ID; each id lies in exactly one
    piece. Each input partition is packed by itself and in its order, so no text
    is shuffled; the rest at its end becomes sequences of power-of-two lengths,
    which need no padding. A task holds RUN_IDS ids and one document. A null or
    empty text is END_ID alone; repeated rows are packed as often as they occur;
    a null doc_id stays null; an empty table gives no pieces. Other columns are
    not looked at. ids: little-endian unsigned 32-bit.
    """
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack_partition(window, tokenizer_path), PIECES)


def unpack_ids(raw: bytes) -> list[int]:
    """The ids of a piece."""
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def with_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(pack_documents(table(spark, sf_dir, "documents")))
