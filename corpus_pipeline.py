"""A training corpus from `documents`: five stages, each on all that its predecessor kept.

Toxic documents go, one document of each group of near copies stays, documents
that hold a benchmark item go, personal data becomes pseudonyms, and what is
left is packed into sequences. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import toxicity as toxic
from lumenframe.llm.decontamination import decontaminate
from lumenframe.llm.neardup import without_near_duplicates
from lumenframe.llm.packing import pack_documents, with_digest
from lumenframe.llm.pii import key_of, pseudonymize
from lumenframe.session import materialize, table

#: Words in a shingle of the stage that drops near copies.
SHINGLE_WORDS = 5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier accepts; it learns from the labelled ones among docs.

    Null texts count as empty and stay unless empty ones score as toxic. Without
    labels of both kinds every row stays. Rows are independent: repeated rows go
    or stay together. No rows give no rows; further columns are kept.
    """
    return toxic.without_toxic(docs, toxic.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies.

    Rows of a null doc_id, and null or empty texts of different ids, all stay; of
    rows that share a doc_id one stays. Long texts count whole. No rows give no
    rows; further columns are kept.
    """
    return without_near_duplicates(docs, SHINGLE_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Each row is judged by its own whole text, whatever its doc_id. Null and empty
    texts stay; without items every row does. Repeated rows go or stay together.
    No rows give no rows; further columns are kept.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data in text; n_chars follows the new text.

    Null and empty texts stay as they are, repeated rows stay equal, and further
    columns are kept. No rows give no rows.
    """
    return pseudonymize(docs, key_of(spark), spans=None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as of op1_packing.

    A null or empty text is its end alone; repeated rows are packed as often as
    they occur; a null doc_id stays null. No rows give no pieces.
    """
    return with_digest(pack_documents(docs))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: Classifier, minima of hashes and tokenizer are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
