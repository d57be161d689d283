"""Queries on inputs unlike the driver's small tables, against their SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import matching, selection
from lumenframe.plans.queries import ORACLE, QUERIES


@pytest.fixture
def against_sql(spark, tmp_path):
    """(rows of the query alone, rows of its SQL alone) on tables given as DataFrames."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, df in tables.items():
            df.write.parquet(f"{tmp_path}/{table}.parquet")
            con.sql(f"create view {table} as from '{tmp_path}/{table}.parquet/*.parquet'")
        QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
        columns = ", ".join(f'"{c}"' for c in con.sql(f"from '{tmp_path}/out/*.parquet'").columns)
        con.sql(f"create table mine as from '{tmp_path}/out/*.parquet'")
        con.sql(f"create table theirs as select {columns} from ({ORACLE[name]})")
        return con.sql("from mine except all from theirs").fetchall(), con.sql("from theirs except all from mine").fetchall()

    return run


def events(spark, rows):
    """Events of (user_id, event_type, value), a second apart."""
    own = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "event_id long, user_id long, event_type string, value double")
    return own.selectExpr("event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, event_id) as ts", "user_id", "event_type", "value")


def test_vitc_checks_of_long_user_ids(spark, against_sql):
    rows = [(user, kind, 1.0) for user in (0, 65_535, 65_536, 74_999, 89_999, 2**40 + 5) for kind in ("view", "error")]
    assert against_sql("vitc_checks", events=events(spark, rows)) == ([], [])


ODD_VALUES = (1.5, 0.0, -1.5, None, math.inf, 93.0, -math.inf, math.nan, -50.0, 1e-300, 4.0, None, None, None, None, None, 250.0)


def test_score_functions_of_odd_values(spark, against_sql):
    assert against_sql("score_functions", events=events(spark, [(1, "view", v) for v in ODD_VALUES])) == ([], [])


def test_momentary_loudness_of_silence_and_odd_values(spark, against_sql):
    """A stream that starts silent, so that its first levels are minus infinity, and one of odd values."""
    rows = [(1, "view", v) for v in (0.0, 0.0, 1.17, 0.0, 0.0, 0.0, 0.0, 0.0)] + [(2, "view", v) for v in ODD_VALUES]
    assert against_sql("momentary_loudness", events=events(spark, rows)) == ([], [])


def test_best_worker_chooses_once_for_tasks_alike(spark):
    """Preference is asked for (kind, worker), not (task, worker); tasks without a worker are left out, null kinds may have one."""
    asked = spark.sparkContext.accumulator(0)

    def big(load):
        asked.add(1)
        return load is not None and load > 50

    kinds = [None, "a", "b", "none"]
    tasks = spark.createDataFrame([(i, kinds[i % 4]) for i in range(4000)], "task long, kind string")
    workers = spark.createDataFrame([(1, "a", 60.0), (2, "a", 10.0), (3, "b", 10.0), (4, "b", 10.0), (5, None, 99.0)], "worker long, skill string, load double")
    found = matching.best_worker(tasks, workers, ["task"], F.col("kind").eqNullSafe(F.col("skill")), F.udf(big, "boolean")("load"), "load", "worker", ["kind"])
    assert {(r["task"], r["worker"]) for r in found.collect()} == {(i, {None: 5, "a": 1, "b": 3}[kinds[i % 4]]) for i in range(4000) if i % 4 < 3}
    assert 5 <= asked.value <= 20


def test_ladder_broadcasts_nothing_that_grows(spark, against_sql):
    """Spark takes the sides for small, as they come from a small file; in the driver they are not."""
    parts = spark.range(60).selectExpr("id as p_partkey", "cast(id % 50 + 1 as int) as p_size")
    assert against_sql("ladder", part=parts) == ([], [])
    profiles = parts.selectExpr("p_partkey", "p_size / 50 as complexity", "24.0D as fps", "2073600 as source_pixels")
    assert "Broadcast" not in selection.ladder(profiles, "p_partkey")._jdf.queryExecution().executedPlan().toString()
