"""Licence scan by canonical digest.

A text is brought to canonical form (copyright lines dropped, lower case,
punctuation as blanks, equivalent spellings made one) and hashed; the digest is
hash-joined with those of known licences. The entire text of a document is one
unit, and each of its lines another, so that a notice on a line of its own
inside a longer document is found as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import only
from lumenframe.llm.license_texts import EQUIVALENT_SPELLINGS, KNOWN_DIGESTS, KNOWN_LICENSES, KNOWN_NOTICES
from lumenframe.session import table

#: Lines that name a copyright and its holder, with what may stand before as a comment mark.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;%-]*(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©|[0-9]{4}|<|\[|by\b)[^\n]*$"
#: Words after "copyright" where licences speak of it; fixed values.
_SPOKEN = r"(?:holders?|owners?|ownership|notices?|law|laws|act|line|disclaimers?|permissions?|interests?|resulting|treaty|treaties|those|licen[cs]\w*|statements?|patents?|doctrines?|protection|rights?|infring\w*|terms?|control|status|material|work|works|and|or|of|on|in|is|are|as|if|to|for|also|with|that|which|under|may|shall|must|can|will|has|have|it|this|these|any|all|does|not|a|an|the(?![^\n]*(?:authors?|contributors|developers|team|foundation|project)[ \t.]*$))\b"
#: Short lines that begin with the word and go on with a holder.
HOLDER_LINE = rf"(?m)^[ \t#*/;%-]*copyright(?:[ \t]*:[ \t]*|[ \t]+)(?!{_SPOKEN})[\p{{L}}\p{{N}}'\"][^\n]{{0,99}}$"
#: A line of a copyright that goes on in the next: it ends in a comma or a joining word, or in a year with the holder alone below.
WRAPPED_HOLDER = rf"(?mi)^([ \t#*/;%-]*(?:copyright|\(c\)|©)[ \t]*(?!\s*{_SPOKEN})[^\n]{{0,100}}?(?:(?:,|&|\b(?:and|the|of|by|for))(?=[ \t]*\n[^\n]{{1,80}}$)|[0-9]{{4}},?(?=[ \t]*\n[^\n]{{1,60}}\n[ \t#*/;%-]*$)))[ \t]*\n(?![^\n]*(?:licen[cs]e|permission|redistribution|provided))"
RIGHTS_LINE = r"(?m)^[ \t#*/;%-]*all rights reserved\.?[ \t]*$"
#: Up to so many known digests (some 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000


def plain(text: Column) -> Column:
    """Lower case without copyright lines and punctuation; null: empty."""
    lines = F.lower(F.coalesce(text, F.lit("")))
    kept = reduce(lambda done, line: F.regexp_replace(done, line, " "), (COPYRIGHT_LINE, HOLDER_LINE, RIGHTS_LINE), lines)
    marked = F.regexp_replace(kept, r"\(c\)|©", " copyright ")
    joined = F.regexp_replace(marked, r"&", " and ")
    return F.trim(F.regexp_replace(joined, r"[^\p{L}\p{N}]+", " "))


def unwrapped(text: Column) -> Column:
    """text with each copyright line and the line its holder goes on in made one; null: empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WRAPPED_HOLDER, "$1 ")


def spelled(text: Column) -> Column:
    """A plain text with equivalent spellings made one: the canonical form."""
    return reduce(lambda done, rule: F.regexp_replace(done, *rule), EQUIVALENT_SPELLINGS, text)


def digest(plain_text: Column) -> Column:
    return F.sha2(spelled(plain_text), 256)


def _pairs(spark: SparkSession, pairs) -> DataFrame:
    """(license_id, text) of a fixed list, as one literal."""
    both = spark.range(1).select(F.explode(F.split(F.lit("\x1e".join(f"{name}\x1f{text}" for name, text in pairs)), "\x1e")).alias("pair"))
    return both.select(F.substring_index("pair", "\x1f", 1).alias("license_id"), F.substring_index("pair", "\x1f", -1).alias("text"))


def known_digests(spark: SparkSession, known=KNOWN_LICENSES + KNOWN_NOTICES, digests=KNOWN_DIGESTS) -> DataFrame:
    """(digest, license_id) of the known texts, one row a digest; a fixed list, so it is broadcast."""
    rows, own = _pairs(spark, known), _pairs(spark, digests)
    texts = rows.select(digest(plain(unwrapped(F.col("text")))).alias("known_digest"), "license_id")
    return texts.unionAll(own.select("text", "license_id")).groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row a document: digest and license_id of its entire text, and its notices.

    license_id is null if the text is no known licence. notice_lines counts the
    lines that are known texts, notices lists their licences, sorted and joined
    by commas ('' if none). Texts with nothing but marks have the digest of the
    empty text, which is no licence. Rows of one doc_id are taken together: the
    smallest digest and licence, and the lines of all. A null doc_id is an id of
    its own. An empty table gives no rows. Other columns are not looked at.
    known: (known_digest, license_id), one row a digest, of any size.
    """
    if known is None:
        known = F.broadcast(known_digests(docs.sparkSession))
    elif known.count() <= BROADCAST_DIGESTS:
        known = F.broadcast(known)
    # Lines are made plain once; joined by blanks they are the plain form of the whole.
    lines = only(docs, "doc_id", "text").select("doc_id", F.transform(F.split(unwrapped(F.col("text")), "\n"), plain).alias("lines"))
    whole_text = F.array_join(F.array_remove("lines", ""), " ")
    own_lines = F.when(F.size("lines") > 1, F.col("lines")).otherwise(F.array().cast("array<string>"))
    units = lines.select("doc_id", F.posexplode(F.concat(F.array(whole_text), own_lines)).alias("unit", "text"))
    digested = units.select("doc_id", "unit", digest(F.col("text")).alias("digest"))
    matched = digested.join(known, F.col("digest") == F.col("known_digest"), "left").where((F.col("unit") == 0) | F.col("license_id").isNotNull())
    whole, line = F.col("unit") == 0, F.col("unit") > 0
    return matched.groupBy("doc_id").agg(
        F.min(F.when(whole, F.col("digest"))).alias("digest"),
        F.min(F.when(whole, F.col("license_id"))).alias("license_id"),
        F.count_if(line).alias("notice_lines"),
        F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("license_id")))), ",").alias("notices"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    own = f"lower(coalesce({text}, ''))"
    rules = [(COPYRIGHT_LINE, " "), (RIGHTS_LINE, " "), (r"\(c\)|©", " copyright "), ("&", " and "), (r"[^\p{L}\p{N}]+", " ")]
    for pattern, by in rules:
        own = f"regexp_replace({own}, {_sql_text(pattern)}, {_sql_text(by)}, 'g')"
    own = f"trim({own})"
    for pattern, by in EQUIVALENT_SPELLINGS:
        own = f"regexp_replace({own}, {_sql_text(pattern)}, {_sql_text(by.replace('$', chr(92)))}, 'g')"
    return f"sha256({own})"


OP9_SQL = f"""
WITH known AS (
  SELECT {_sql_canonical('text')} AS known_digest, min(license_id) AS license_id
  FROM (VALUES {", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in KNOWN_LICENSES)}) AS k(license_id, text)
  GROUP BY 1),
units AS (
  SELECT doc_id, 0 AS unit, coalesce(text, '') AS text FROM documents
  UNION ALL
  SELECT doc_id, 1 AS unit, unnest(string_split(text, chr(10))) AS text FROM documents WHERE contains(text, chr(10))),
digested AS (SELECT doc_id, unit, {_sql_canonical('text')} AS digest FROM units),
matched AS (SELECT doc_id, unit, digest, license_id FROM digested LEFT JOIN known ON digest = known_digest)
SELECT doc_id,
  min(digest) FILTER (unit = 0) AS digest,
  min(license_id) FILTER (unit = 0) AS license_id,
  count(*) FILTER (unit > 0 AND license_id IS NOT NULL) AS notice_lines,
  coalesce(string_agg(DISTINCT license_id, ',' ORDER BY license_id) FILTER (unit > 0), '') AS notices
FROM matched GROUP BY doc_id
"""
