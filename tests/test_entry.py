import importlib
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from lumenframe.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_llm_folders(monkeypatch):
    """The entry file works where the subpackage and the pipeline are gone."""
    real = importlib.util.find_spec
    gone = ("lumenframe.llm", "corpus_pipeline")
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(gone) else real(name, *a))
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) == set(ORACLE)


def test_library_does_not_import_llm():
    code = "import sys, lumenframe.plans.queries, lumenframe.streaming.state; print([m for m in sys.modules if m.startswith('lumenframe.llm')])"
    assert os.popen(f"{sys.executable} -c \"{code}\"").read().strip() == "[]"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for file in os.listdir(SF):
        con.sql(f"create view {file.split('.')[0]} as from '{SF}/{file}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, tables, tmp_path, name):
    QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    mine = tables.sql(f"from '{tmp_path}/out/*.parquet'")
    theirs = tables.sql(f"select * from ({ORACLE[name]})")
    assert dict(zip(mine.columns, map(str, mine.types), strict=True)) == dict(zip(theirs.columns, map(str, theirs.types), strict=True))
    columns = ", ".join(f'"{c}"' for c in sorted(mine.columns))
    tables.sql(f"create or replace table mine as select {columns} from '{tmp_path}/out/*.parquet'")
    tables.sql(f"create or replace table theirs as select {columns} from ({ORACLE[name]})")
    assert tables.sql("from mine except all from theirs").fetchall() == []
    assert tables.sql("from theirs except all from mine").fetchall() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
