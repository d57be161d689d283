"""Files of test streams as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of raw test streams; fixed values.
EXTENSIONS = ("264", "h264")


def load_streams(spark: SparkSession, folder: str, deep: bool = False) -> DataFrame:
    """(stream_id, path, length, sha256) of the raw streams in a folder, or at any depth below it.

    The id is the file's name without its extension. Contents are read only if
    sha256 is asked for. A folder without such files gives no rows; empty files give
    none either, as Spark's reader passes them over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).option("pathGlobFilter", f"*.{{{','.join(EXTENSIONS)}}}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(name, r"\.[^.]+$", "").alias("stream_id"), "path", "length", F.sha2("content", 256).alias("sha256"))
