"""Edit lists as XML: clip items to rows and rows to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that XML escapes; fixed values. The ampersand comes first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def escaped(text: Column) -> Column:
    for mark, name in ESCAPES:
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def unescaped(text: Column) -> Column:
    for mark, name in reversed(ESCAPES):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


def _tag(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf"(?s)<{name}>(.*?)</{name}>", 1)


def parse_edit_xml(df: DataFrame, key: str, text: str, default_rate: float = 30.0) -> DataFrame:
    """(key, title, place, source, source_in, source_out, record_in, record_out) of each clip item, times in seconds.

    The title is the name that the sequence has before its media; '' for none. The
    frame rate is that of the first timebase. Missing numbers are 0.
    """
    rate = F.coalesce(_tag(F.col(text), "timebase").try_cast("double"), F.lit(float(default_rate)))
    items = F.regexp_extract_all(F.col(text), F.lit(r"(?s)<clipitem[^>]*>(.*?)</clipitem>"), F.lit(1))
    head = F.regexp_extract(F.col(text), r"(?s)<sequence[^>]*>(.*?)(?:<media>|</sequence>)", 1)
    rows = df.select(key, unescaped(_tag(head, "name")).alias("title"), rate.alias("__rate"), F.posexplode(items).alias("place", "__item"))
    seconds = lambda name: F.coalesce(_tag(F.col("__item"), name).try_cast("long"), F.lit(0)) / F.col("__rate")
    return rows.select(key, "title", "place", unescaped(_tag(F.col("__item"), "name")).alias("source"), seconds("in").alias("source_in"), seconds("out").alias("source_out"), seconds("start").alias("record_in"), seconds("end").alias("record_out"))


def edit_xml(edits: DataFrame, key: str, order: str, rate: float) -> DataFrame:
    """(key, xml): the edits of each list as one text, which is what it is."""
    fields = ("source", "source_in", "source_out", "record_in", "record_out")
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), *[F.col(c) for c in fields])))
    frame = lambda e, c: F.round(e[c] * rate).cast("long").cast("string")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    item = lambda e: tag("clipitem", F.concat(tag("name", escaped(e["source"])), tag("start", frame(e, "record_in")), tag("end", frame(e, "record_out")), tag("in", frame(e, "source_in")), tag("out", frame(e, "source_out"))))
    own = edits.groupBy(key).agg(rows.alias("__e"), F.max("record_out").alias("__d"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<xmeml version="5"><sequence>'), tag("name", escaped(F.col(key).cast("string"))), tag("duration", F.round(F.col("__d") * rate).cast("long").cast("string")), tag("rate", tag("timebase", F.lit(str(rate)))))
    return own.select(key, F.concat(head, F.lit("<media><video><track>"), F.array_join(F.transform("__e", item), ""), F.lit("</track></video></media></sequence></xmeml>\n")).alias("xml"))
