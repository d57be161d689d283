import random

import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside, as further columns of their input.
CLASHES = "n w key hash unit shard slot digest score label component node a b __piece __n component_id row_id text2 held_out".split()


def with_clashes(df):
    return df.withColumns({name: F.lit(f"clash {name}") for name in CLASHES})


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture(scope="session")
def edge_rows():
    rng = random.Random(5)
    long = prose(rng, 60_000, 5_000)
    base = prose(rng, 120)
    return [
        (1, base),
        (2, base),
        (3, base + " tail"),
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (7, "One two"),
        (8, "one\ntwo"),
        (9, long),
        (10, long + " end"),
        (11, prose(rng, 200)),
        (11, prose(rng, 200)),
        (12, "same row"),
        (12, "same row"),
        (None, "no id"),
        (13, "Ünïcode straße 東京 😀 one two three four five"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return with_clashes(spark.createDataFrame(edge_rows, "doc_id long, text string")).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return with_clashes(spark.createDataFrame([], "doc_id long, text string"))
