"""Alert rules, compliance rules, caption checks and stream selectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Metrics for which alert rules fire; others never do. Fixed values.
ALERT_METRICS = ("psnr", "ssim", "vmaf", "bitrate")


@dataclass(frozen=True)
class AlertRule:
    """kind: below (lo), above (hi) or out_of_range (lo, hi); cooldown in rows of a stream."""

    name: str
    metric: str
    kind: str
    lo: float = 0.0
    hi: float = 0.0
    severity: str = "warning"
    enabled: bool = True
    cooldown: int = 0

    def breached(self, value: Column) -> Column:
        return {"below": value < self.lo, "above": value > self.hi, "out_of_range": (value < self.lo) | (value > self.hi)}[self.kind]


def fired(long: DataFrame, rules: Sequence[AlertRule], metric: str, value: str) -> DataFrame:
    """A row for each rule that a long-format value breaches; the rules are columns, so nothing is joined."""
    checks = [
        F.when((F.col(metric) == r.metric) & r.breached(F.col(value)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.cooldown).alias("cooldown")))
        for r in rules
        if r.enabled and r.metric in ALERT_METRICS
    ]
    if not checks:
        return long.withColumns({"rule": F.lit(None).cast("string"), "severity": F.lit(None).cast("string"), "cooldown": F.lit(None).cast("int")}).limit(0)
    return long.withColumn("__alert", F.explode(F.array_compact(F.array(*checks)))).select(*long.columns, "__alert.*")


@dataclass(frozen=True)
class Condition:
    """field operator value; operators: eq ne gt ge lt le contains exists matches."""

    field: str
    operator: str
    value: str = ""

    def violated(self, facts: Sequence[str]) -> Column:
        """Whether a row of facts (columns) breaks it. A missing field breaks `exists` alone."""
        field = F.col(self.field).cast("string") if self.field in facts else F.lit(None).cast("string")
        if self.operator == "exists":
            return field.isNull()
        number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
        value = F.lit(self.value)
        kept = {
            "eq": field == value,
            "ne": field != value,
            "contains": field.contains(self.value),
            "gt": number(field) > number(value),
            "ge": number(field) >= number(value),
            "lt": number(field) < number(value),
            "le": number(field) <= number(value),
            "matches": _matches(field, self.value),
        }[self.operator]
        return field.isNotNull() & ~kept


def _matches(field: Column, pattern: str) -> Column:
    """Search anywhere; a pattern that is not valid matches nothing."""
    import re

    try:
        re.compile(pattern)
    except re.error:
        return field.isNull() & field.isNotNull()
    return field.rlike(pattern)


@dataclass(frozen=True)
class ComplianceRule:
    name: str
    regulation: str
    severity: str
    conditions: tuple[Condition, ...]


def rule_violations(facts: DataFrame, rules: Sequence[ComplianceRule], key: str, active: Sequence[str]) -> DataFrame:
    """(key, rule, severity, field) of each active rule's first violated condition."""
    checks = []
    for rule in rules:
        if rule.regulation not in active:
            continue
        first = reduce(lambda chain, c: chain.when(c.violated(facts.columns), F.lit(c.field)), rule.conditions[1:], F.when(rule.conditions[0].violated(facts.columns), F.lit(rule.conditions[0].field)))
        checks.append(F.when(first.isNotNull(), F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"), first.alias("field"))))
    return facts.select(key, F.explode(F.array_compact(F.array(*checks))).alias("v")).select(key, "v.*")


def compliant(facts: DataFrame, rules: Sequence[ComplianceRule], key: str, active: Sequence[str]) -> DataFrame:
    """(key, violations, passed): passed without violations of severity error or critical."""
    found = rule_violations(facts, rules, key, active).groupBy(key).agg(F.count("*").alias("violations"), F.count_if(F.col("severity").isin("error", "critical")).alias("__bad"))
    return facts.select(key).join(found, key, "left").select(key, F.coalesce("violations", F.lit(0)).alias("violations"), (F.coalesce("__bad", F.lit(0)) == 0).alias("passed"))


def words_per_minute(text: Column, start_ms: Column, end_ms: Column) -> Column:
    """White-space words a minute; 0 for cues of no duration."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    words = F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, r"\s+")))
    return F.when(end_ms > start_ms, words / ((end_ms - start_ms) / 60000)).otherwise(0.0)


def chars_per_second(text: Column, start_ms: Column, end_ms: Column) -> Column:
    return F.when(end_ms > start_ms, F.length(text) / ((end_ms - start_ms) / 1000)).otherwise(0.0)


@dataclass(frozen=True)
class CaptionStandard:
    name: str
    min_ms: int = 1000
    max_cps: float = 20.0
    max_wpm: float = 200.0
    max_gap_ms: int = 5000


def caption_issues(cues: DataFrame, doc: str, order: str, standards: Sequence[CaptionStandard]) -> DataFrame:
    """(doc, order, standard, issue) of cues that are short, fast, wordy, empty or far from the next."""
    ordered = W.partitionBy(doc).orderBy(order)
    own = cues.withColumn("__len", F.col("end_ms") - F.col("start_ms")).withColumn("__gap", F.lead("start_ms").over(ordered) - F.col("end_ms"))
    own = own.withColumn("__cps", chars_per_second(F.col("text"), F.col("start_ms"), F.col("end_ms"))).withColumn("__wpm", words_per_minute(F.col("text"), F.col("start_ms"), F.col("end_ms")))
    issues = []
    for s in standards:
        for name, broken in (("too_short", F.col("__len") < s.min_ms), ("too_fast", F.col("__cps") > s.max_cps), ("too_wordy", F.col("__wpm") > s.max_wpm), ("empty", F.length(F.trim("text")) == 0), ("gap", F.col("__gap") > s.max_gap_ms)):
            issues.append(F.when(broken, F.struct(F.lit(s.name).alias("standard"), F.lit(name).alias("issue"))))
    return own.select(doc, order, F.explode(F.array_compact(F.array(*issues))).alias("i")).select(doc, order, "i.*")


def stream_selector(spec: str) -> Column:
    """Predicate on (file_index, stream_index, stream_type) of '', 'v', 'a:0', '3' or '0:v:1'.

    stream_type: video, audio, subtitle, data; a type's index counts within its
    file and type and is the column type_index.
    """
    kinds = {"v": "video", "a": "audio", "s": "subtitle", "d": "data"}
    parts = [p for p in spec.split(":") if p != ""]
    if not parts:
        return F.lit(True)
    conditions = []
    if parts[0].isdigit() and len(parts) > 1:
        conditions.append(F.col("file_index") == int(parts.pop(0)))
    if parts[0] in kinds:
        conditions.append(F.col("stream_type") == kinds[parts.pop(0)])
        if parts:
            conditions.append(F.col("type_index") == int(parts.pop(0)))
    elif parts[0].isdigit():
        conditions.append(F.col("stream_index") == int(parts.pop(0)))
    if parts:
        raise ValueError(f"not a stream specifier: {spec}")
    return reduce(lambda a, b: a & b, conditions)


def track_selector(ids: dict[str, Sequence[int]] | None = None, language: str | None = None, min_width: int | None = None) -> Column:
    """Predicate on (track_type, track_id, language, width).

    Listed ids bind their type; language binds audio and text, min_width video;
    a null language or width passes.
    """
    conditions = [F.lit(True)]
    for kind, own in (ids or {}).items():
        conditions.append((F.col("track_type") != kind) | F.col("track_id").isin(*own))
    if language is not None:
        conditions.append(~F.col("track_type").isin("audio", "text") | F.col("language").isNull() | (F.col("language") == language))
    if min_width is not None:
        conditions.append((F.col("track_type") != "video") | F.col("width").isNull() | (F.col("width") >= min_width))
    return reduce(lambda a, b: a & b, conditions)
