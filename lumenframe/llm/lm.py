"""Language-model scoring by prediction by partial matching (PPM).

A text's tokens (words of the A-Z-lower-cased text, then one end) are written as
bytes: words joined by blanks, closed by a line feed, which no word holds. A trie
of byte contexts, of up to ORDER bytes, predicts each byte. A context of n
occurrences gives c / n of what the escape leaves to a byte seen c times; the
escape goes to the next shorter context, where the bytes already ruled out are
excluded; below the empty context all bytes left are alike. Escapes are
estimated for classes of contexts by leaving out each training occurrence in
turn. A document's score is the sum over its bytes of log10 of their probability.

Training: the counts of (ORDER + 1)-grams over all training documents hold the
whole trie. Spark sums them and derives from them a table of the grams of every
length, one of the contexts, and the bounded one of the escape classes, so the
model may be of any size. Scoring is one pass over the texts, at every size of
the model: the scorers hold the probabilities of the FREQUENT_GRAMS most
frequent grams; all others, and grams that training didn't see, are counted by
document and joined with the tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.llm.common import Shared, collect_bounded, only, rest_crc32, worker_cache
from lumenframe.session import materialize, table

ORDER = 5
WIDTH = ORDER + 1
END = b"\n"
#: Most grams and words whose probabilities the scorers hold (16 bytes each sent, some 60 in a scorer); all rarer ones are joined.
FREQUENT_GRAMS, FREQUENT_WORDS = 3_000_000, 1 << 18
#: Cases by which the prior of an escape class counts.
PRIOR_CASES = 2.0
#: Bytes scored at once.
SEGMENT = 1 << 20
#: Most counts that a task merges in memory (16 bytes each, some 60 while they are merged); further ones are further rows.
HELD_COUNTS = 2_000_000
MODULUS, HELD_OUT = 10, 0


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; null: none. The end is not among them."""
    return (text or "").encode().lower().split()


def message(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def _segments(messages: list[bytes]) -> list[list[tuple[int, bytes, int]]]:
    """Groups of about SEGMENT bytes of (document, ORDER bytes before and a run of its bytes, length of the run)."""
    groups, own, held = [], [], 0
    for doc, text in enumerate(messages):
        for at in range(0, len(text), SEGMENT):
            run = text[at : at + SEGMENT]
            before = END * ORDER if not at else text[at - ORDER : at]
            own.append((doc, before + run, len(run)))
            held += len(run)
            if held >= SEGMENT:
                groups.append(own)
                own, held = [], 0
    return [*groups, own] if own else groups


def _grams(group: list[tuple[int, bytes, int]]) -> np.ndarray:
    """The gram of each byte of the runs as a number, the predicted byte lowest."""
    data = np.frombuffer(b"".join(run for _, run, _ in group), np.uint8)
    wide = data.astype(np.uint64)
    grams = np.zeros(len(data) - ORDER, np.uint64)
    for k in range(WIDTH):
        grams = grams << np.uint64(8) | wide[k : len(data) - ORDER + k]
    lengths = np.array([n for _, _, n in group])
    keep = np.ones(len(grams), bool)
    starts = np.cumsum(lengths + ORDER)[:-1]  # where the bytes before each later run begin
    for k in range(ORDER):
        keep[starts - ORDER + k] = False
    return grams[keep]


class HashTable:
    """Values of 64-bit keys, looked up for whole arrays at once; open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        mask = (1 << self.bits) - 1
        at, self.steps = np.full(1 << self.bits, -1, np.int64), 0
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            tried = (slots[left] + self.steps) & mask
            free = at[tried] < 0
            at[tried[free]] = left[free]
            left = left[at[tried] != left]
            self.steps += 1
        self.used = at >= 0
        self.keys = np.where(self.used, keys[at] if len(keys) else 0, 0).astype(np.uint64)
        self.values = np.where(self.used, values[at] if len(keys) else 0, 0).astype(values.dtype)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found); values of keys that aren't there are 0."""
        slots = self._slots(keys)
        found = (self.keys[slots] == keys) & self.used[slots]
        values = np.where(found, self.values[slots], 0)
        left = np.flatnonzero(~found & self.used[slots])
        for step in range(1, self.steps):
            if not len(left):
                break
            tried = (slots[left] + step) & ((1 << self.bits) - 1)
            hit = (self.keys[tried] == keys[left]) & self.used[tried]
            values[left[hit]], found[left[hit]] = self.values[tried[hit]], True
            left = left[~hit & self.used[tried]]
        return values, found


class AdaptivePPM:
    """Adaptive code length: the trie learns each byte of a document once it is coded.

    With nothing to estimate escapes from, q different bytes in n occurrences
    escape with q / (n + q).
    """

    def __init__(self) -> None:
        self.counts: dict[bytes, dict[int, int]] = {}

    def learn(self, context: bytes, symbol: int) -> None:
        for size in range(len(context) + 1):
            own = self.counts.setdefault(context[len(context) - size :], {})
            own[symbol] = own.get(symbol, 0) + 1

    def log10_of(self, context: bytes, symbol: int) -> float:
        total, excluded = 0.0, set()
        for size in range(len(context), -1, -1):
            own = {s: c for s, c in self.counts.get(context[len(context) - size :], {}).items() if s not in excluded}
            n, q = sum(own.values()), len(own)
            if symbol in own:
                return total + math.log10(own[symbol] / (n + q))
            if q:
                total += math.log10(q / (n + q))
            excluded |= own.keys()
        return total - math.log10(256 - len(excluded))

    def code(self, text: str, learn: bool = True) -> float:
        """log10 probability of a text; with learn, each byte is learnt once it is coded."""
        data, total = END * ORDER + message(tokens(text)), 0.0
        for at in range(ORDER, len(data)):
            context = data[at - ORDER : at]
            total += self.log10_of(context, data[at])
            if learn:
                self.learn(context, data[at])
        return total


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words and the end; words are told apart by them."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, [*words, END]), np.uint64, len(words) + 1)


class _Counts:
    """Sums of counts by 64-bit key, merged now and then; add() returns what has become too much to hold."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        own, n = np.unique(keys, return_counts=True)
        self.parts.append((own, n))
        self.held += len(own)
        if self.held > HELD_COUNTS:
            self.parts = [self.total()]
            self.held = len(self.parts[0][0])
            if self.held > HELD_COUNTS * 3 // 4:
                out, self.parts, self.held = self.parts[0], [], 0
                return out
        return None

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, n = np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts])
        self.parts = []
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(n, first)


def _texts_in_groups(column, size: int = SEGMENT):
    """Lists of word lists, of about `size` bytes each."""
    own, held = [], 0
    for text in column:
        words = tokens(text.as_py())
        own.append(words)
        held += sum(map(len, words))
        if held >= size:
            yield own
            own, held = [], 0
    if own:
        yield own


def _count_partition(batches):
    """(kind, key, n) of a partition's words and grams; a key comes again where the counts were too many to hold."""
    worker_cache().pop("shared", None)  # a worker may still hold the tables of an earlier model

    def rows(kind: int, counts: tuple[np.ndarray, np.ndarray] | None):
        keys, n = counts or ((), ())
        for at in range(0, len(keys), 1 << 16):
            own = keys[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own.view(np.int64)), pa.array(n[at : at + (1 << 16)])], ["kind", "key", "n"])

    words, grams = _Counts(), _Counts()
    for batch in batches:
        for group in _texts_in_groups(batch.column(0)):
            yield from rows(0, words.add(np.concatenate([_word_hashes(w) for w in group])))
            for part in _segments([message(w) for w in group]):
                yield from rows(1, grams.add(_grams(part)))
    yield from rows(0, words.total())
    yield from rows(1, grams.total())


#: Columns of the trie's tables by the length of a context in bytes (size) and the bytes as a number.
_SUFFIX = "key & (shiftleft(1L, 8 * size) - 1)"
_PARENT = "context & (shiftleft(1L, 8 * greatest(size - 1, 0)) - 1)"


def _gram_levels(grams: DataFrame) -> DataFrame:
    """A row for each gram of each size: (size, key, context, c, seen, n, q, once, taken, head).

    grams: (key, n) of the longest. c: the gram's occurrences; seen: those of its
    bytes but for the first; n, q, once: occurrences, different bytes and bytes
    seen once after its context; taken: the sum of seen over those bytes; head
    marks one gram a context. No window has more than 256 rows.
    """
    each = grams.select("key", "n", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("size"))
    counts = each.groupBy("size", F.expr("key & (shiftleft(1L, 8 * (size + 1)) - 1)").alias("key")).agg(F.sum("n").alias("c"))
    by_suffix, by_context = W.partitionBy("size", F.expr(_SUFFIX)), W.partitionBy("size", "context")
    rows = counts.select("size", "key", F.shiftright("key", 8).alias("context"), "c", F.sum("c").over(by_suffix).alias("seen"))
    sums = {"n": F.sum("c"), "q": F.count("*"), "once": F.count_if(F.col("c") == 1), "taken": F.sum("seen"), "least": F.min("key")}
    return rows.withColumns({name: of.over(by_context) for name, of in sums.items()}).withColumn("head", F.col("least") == F.col("key")).drop("least")


def _contexts(levels: DataFrame) -> DataFrame:
    """(size, context, n, q, once, left_n, left_q); left: of the next shorter context, less the bytes seen in this one."""
    own = levels.where("head").select("size", "context", "n", "q", "once", "taken", F.expr(_PARENT).alias("parent"))
    shorter = own.select((F.col("size") + 1).alias("size"), F.col("context").alias("parent"), F.col("n").alias("parent_n"), F.col("q").alias("parent_q"))
    left = {"left_n": F.col("parent_n") - F.col("taken"), "left_q": F.col("parent_q") - F.col("q")}
    return own.join(shorter, ["size", "parent"], "left").withColumns(left).drop("parent", "parent_n", "parent_q", "taken")


def _escape_class(n: Column, q: Column) -> Column:
    """Classes of (n, q): single up to 4, then four to a doubling."""
    n, q = (F.when(x <= 4, x).otherwise(F.floor(F.log2(x.cast("double")) * 4 - 4 + 1e-9)).cast("int") for x in (n, q))
    return n * 32 + q


def _escape_cases(levels: DataFrame, contexts: DataFrame) -> DataFrame:
    """(left, size, class, cases, escapes) of the training counts, each occurrence left out in turn.

    An occurrence escapes if its byte is not seen in the context but for it. Of n
    occurrences, `once` leave n - 1 of q - 1 bytes and escape; the others leave
    n - 1 of q bytes. left: a byte seen once, left out, escapes to the shorter
    context, where it is not excluded. At most 12 x 200 x 32 classes.
    """
    n, q, once = F.col("n"), F.col("q"), F.col("once")
    whole = F.array(
        F.struct(_escape_class(n - 1, q - 1).alias("class"), once.alias("cases"), once.alias("escapes")),
        F.struct(_escape_class(n - 1, q).alias("class"), (n - once).alias("cases"), F.lit(0).cast("long").alias("escapes")),
    )
    whole = contexts.where(n > 1).select(F.lit(False).alias("left"), "size", F.explode(whole).alias("case")).select("left", "size", "case.*")
    out = levels.where((F.col("size") > 0) & (F.col("c") == 1) & (n > 1)).select("size", "context", (F.col("seen") - 1).alias("others"))
    out = out.join(contexts.select("size", "context", "left_n", "left_q"), ["size", "context"])
    left_n, left_q, alone = F.col("left_n") + F.col("others"), F.col("left_q") + (F.col("others") > 0).cast("long"), (F.col("others") == 0).cast("long")
    left = out.where(left_n > 0).select(F.lit(True).alias("left"), "size", _escape_class(left_n, left_q).alias("class"), F.lit(1).cast("long").alias("cases"), alone.alias("escapes"))
    return whole.unionAll(left).groupBy("left", "size", "class").agg(F.sum("cases").alias("cases"), F.sum("escapes").alias("escapes"))


@dataclass
class Language:
    """What training gathered: (key, n) of words; the trie's tables; N and V; bytes never seen.

    grams: as of _gram_levels(); contexts: as of _contexts(); cases: the bounded
    table of escape classes; unseen is never 0, as UTF-8 doesn't use every byte.
    """

    words: DataFrame
    grams: DataFrame
    contexts: DataFrame
    cases: DataFrame
    total: int
    distinct: int
    unseen: int

    def _with_escape(self, df: DataFrame, n: str, q: str, left: bool, name: str) -> DataFrame:
        """df with the escape probability of (n, q); a class with few cases leans on the prior q / (n + q)."""
        cases = self.cases.where(F.col("left") == left).select("size", F.col("class").alias("__class"), "cases", "escapes")
        joined = df.withColumn("__class", _escape_class(F.col(n), F.col(q))).join(F.broadcast(cases), ["size", "__class"], "left")
        prior = F.coalesce(F.col(q) / F.greatest(F.col(n) + F.col(q), F.lit(1)), F.lit(0.0))
        escape = (F.coalesce("escapes", F.lit(0)) + PRIOR_CASES * prior) / (F.coalesce("cases", F.lit(0)) + PRIOR_CASES)
        return joined.withColumn(name, escape).drop("__class", "cases", "escapes")

    def seen(self) -> DataFrame:
        """(key, n, log10) of every longest gram of training."""
        longest = self._with_escape(self.grams.where(F.col("size") == ORDER), "n", "q", False, "escape")
        return longest.select("key", F.col("c").alias("n"), F.log10(F.col("c") / F.col("n") * (1 - F.col("escape"))).alias("log10"))

    def escaping(self, keys: DataFrame) -> DataFrame:
        """(key, log10) of different longest grams that training didn't see.

        Each is looked up at every size. The tables of the two shortest contexts
        (65,792 grams at most) are broadcast, as all keys meet in their few rows.
        """
        nodes = self._with_escape(self._with_escape(self.contexts, "n", "q", False, "escape"), "left_n", "left_q", True, "left_escape")
        nodes = nodes.select("size", "context", "n", "escape", "left_n", "left_escape")
        grams = self.grams.select("size", F.col("key").alias("gram"), "c")
        places = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("size"))
        places = places.withColumns({"context": F.expr("shiftright(key, 8) & (shiftleft(1L, 8 * size) - 1)"), "gram": F.expr("key & (shiftleft(1L, 8 * (size + 1)) - 1)")})
        parts = []
        for own, side in ((F.col("size") < 2, F.broadcast), (F.col("size") >= 2, lambda df: df)):
            parts.append(places.where(own).join(side(nodes.where(own)), ["size", "context"], "left").join(side(grams.where(own)), ["size", "gram"], "left"))
        values = ("n", "escape", "left_n", "left_escape", "c")
        wide = parts[0].unionByName(parts[1]).groupBy("key").agg(*[F.max(F.when(F.col("size") == size, F.col(v))).alias(f"{v}_{size}") for size in range(ORDER + 1) for v in values])
        total, found = F.lit(0.0), F.lit(False)
        for size in range(ORDER, -1, -1):
            n, escape, c = (F.col(f"{v}_{size}") for v in ("n", "escape", "c"))
            if size < ORDER:
                longer = F.col(f"n_{size + 1}").isNotNull()
                n, escape = F.when(longer, F.col(f"left_n_{size + 1}")).otherwise(n), F.when(longer, F.col(f"left_escape_{size + 1}")).otherwise(escape)
            hit = F.col(f"n_{size}").isNotNull() & c.isNotNull()
            step = F.when(hit, F.log10(c / n * (1 - escape))).when(F.col(f"n_{size}").isNotNull() & (n > 0), F.log10(escape)).otherwise(0.0)
            total, found = total + F.when(found, 0.0).otherwise(step), found | hit
        return wide.select("key", (total - F.when(found, 0.0).otherwise(math.log10(self.unseen))).alias("log10"))


def train(docs: DataFrame) -> Language:
    """Counts over every row of docs; null and empty texts are an end alone."""
    counted = materialize(only(docs, "text").mapInArrow(_count_partition, "kind int, key long, n long"), "lm-parts")
    summed = materialize(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts", partition_by="kind")
    words, grams = (summed.where(F.col("kind") == kind).select("key", "n") for kind in (0, 1))
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("d")).first()
    levels = materialize(_gram_levels(grams), "lm-grams", partition_by="size")
    contexts = materialize(_contexts(levels), "lm-contexts", partition_by="size")
    cases = materialize(_escape_cases(levels, contexts), "lm-escapes")
    return Language(words, levels, contexts, cases, sums["n"] or 0, sums["d"], 256 - levels.where(F.col("size") == 0).count())


class _Lookup:
    """A HashTable that travels as its keys and values; a scorer builds it when it first asks."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.source, self.table = (keys, values), None

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.table is None:
            self.source, self.table = None, HashTable(*self.source)
        return self.table.find(keys)


def _per_document(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, occurrences) of pairs."""
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])])) if len(docs) else np.empty(0, np.int64)
    return docs[first], keys[first], np.diff(np.concatenate([first, [len(docs)]]))


_SCORED = ["kind", "row_id", "doc_id", "key", "n", "known", "base", "score"]
_SCORED_TYPES = "kind int, row_id long, doc_id long, key long, n long, known long, base double, score double"
_DOCUMENT, _WORD, _GRAM = 0, 1, 2


def _score_partition(grams_of, words_of):
    """Rows of documents, with the sums over what the scorers hold, and rows of every other word and gram of each."""

    def others(kind: int, docs: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        docs, keys, n = _per_document(docs, keys)
        none, zero = pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(docs), none, pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), none, zero, zero], _SCORED)

    def score(batches):
        grams, words = grams_of.value, words_of.value
        for batch in batches:
            rows, at = batch.column(0).to_numpy(), 0
            for group in _texts_in_groups(batch.column(2)):
                own = rows[at : at + len(group)]
                hashes = [_word_hashes(w) for w in group]
                sizes = np.array([len(h) for h in hashes])
                joined = np.concatenate(hashes)
                values, found = words.find(joined)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                base, known = np.add.reduceat(values, starts), np.add.reduceat(found.astype(np.int64), starts)
                yield others(_WORD, np.repeat(own, sizes)[~found], joined[~found])
                scores = np.zeros(len(group))
                for part in _segments([message(w) for w in group]):
                    keys, lengths = _grams(part), [n for _, _, n in part]
                    values, found = grams.find(keys)
                    docs = np.array([doc for doc, _, _ in part])
                    np.add.at(scores, docs, np.add.reduceat(values, np.concatenate([[0], np.cumsum(lengths)[:-1]])))
                    yield others(_GRAM, np.repeat(own[docs], lengths)[~found], keys[~found])
                kind, key = pa.array(np.full(len(group), _DOCUMENT, np.int32)), pa.nulls(len(group), pa.int64())
                yield pa.RecordBatch.from_arrays([kind, pa.array(own), batch.column(1).slice(at, len(group)), key, pa.array(sizes), pa.array(known), pa.array(base), pa.array(scores)], _SCORED)
                at += len(group)

    return score


def _frequent(counts: DataFrame, value: str, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, values) of the most frequent keys on the driver, at most `bound`: those from the least count up that allows it."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    steps = sorted(((row["step"], row["count"]) for row in collect_bounded(counts.groupBy(step.alias("step")).count(), 64 * 16 + 1)), reverse=True)
    least, held = None, 0
    for own, count in steps:
        if held + count > bound:
            break
        least, held = own, held + count
    if least is None:
        return np.empty(0, np.uint64), np.empty(0)
    found = counts.where(step >= least).select("key", value).toArrow()
    return found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()


def score_documents(docs: DataFrame, model: Language, frequent_grams: int = FREQUENT_GRAMS, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of docs.

    score: log10 probability of the whole text by the trie. base_score: the sum
    over its tokens of log10((c + 0.1) / (N + 0.1 (V + 1))), c the token's count
    in training, N that of all, V the number of different ones. The most
    frequent words and grams are broadcast, which is for speed alone: all others
    are joined, and the scores are the same whatever the two bounds. Null and
    empty texts are an end alone. Repeated rows get a row each, also those of a
    null doc_id. Without training text every byte is as likely as any, 1 / 256.
    An empty table gives no rows. Other columns are not used.
    """
    spark = docs.sparkSession
    scale = model.total + 0.1 * (model.distinct + 1)
    rows = only(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), "text")
    seen = model.seen()
    keys, counts = _frequent(model.words, "n", frequent_words)
    words = Shared(spark, "lm-words", _Lookup(keys, np.log10((counts + 0.1) / scale)))
    grams = Shared(spark, "lm-grams", _Lookup(*_frequent(seen, "log10", frequent_grams)))
    scored = materialize(rows.mapInArrow(_score_partition(grams, words), _SCORED_TYPES), "lm-scored", partition_by="kind")
    rare = scored.where(F.col("kind") == _WORD).select("row_id", "key", "n").join(model.words.withColumnRenamed("n", "c"), "key", "left")
    rare = rare.groupBy("row_id").agg(F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / F.lit(scale))).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    others = materialize(scored.where(F.col("kind") == _GRAM).select("row_id", "key", "n").join(seen.select("key", "log10"), "key", "left"), "lm-rare-grams")
    new = others.where(F.col("log10").isNull())
    new = new.drop("log10").join(model.escaping(new.select("key").distinct()), "key")
    others = others.where(F.col("log10").isNotNull()).unionByName(new).groupBy("row_id").agg(F.sum(F.col("n") * F.col("log10")).alias("rare_score"))
    whole = scored.where(F.col("kind") == _DOCUMENT).join(rare, "row_id", "left").join(others, "row_id", "left")
    none = F.lit(0.0)
    return whole.select(
        "doc_id", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("rare_base", none)).alias("base_score"), (F.col("score") + F.coalesce("rare_score", none)).alias("score")
    )


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = rest_crc32(F.col("doc_id"), MODULUS) == HELD_OUT
    model = train(docs.where(~held_out))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
