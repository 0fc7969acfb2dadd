"""Every registered query against its SQL on the small tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_file
from tools.check import compare
from wattloom.operators import models
from wattloom.plans import oracle, queries

STATEMENTS = oracle.statements()


@pytest.fixture(scope="module", autouse=True)
def small_models():
    """Full-size fits take minutes; the driver's check runs them, the tests and their SQL run small ones."""
    patch = pytest.MonkeyPatch()
    full = models.Settings
    patch.setattr(models, "Settings", lambda: full(trees=20, tree_depth=8, rounds=12, boost_depth=5))
    STATEMENTS.update(oracle.statements())
    yield
    patch.undo()


@pytest.fixture(scope="module")
def connection(folder):
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(queries.registered()) == set(STATEMENTS)
    assert set(STATEMENTS) <= set(entry_file.queries()) & set(entry_file.oracle_sql())


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_agrees_with_sql(spark, connection, folder, name):
    df = queries.registered()[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert unwanted not in plan
    result = compare(df.toPandas(), connection, STATEMENTS[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    assert entry_file.entry(spark).count() > 0


def test_scan_reads_needed_columns_only(spark, folder):
    plan = entry_file.queries()["household_consumption"](spark, folder)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber" in text
    assert "l_extendedprice" not in text and "p_name" not in text


def test_point_lookup_is_pushed_down(spark, folder):
    text = entry_file.queries()["household_by_id"](
        spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,42)" in text


def test_the_last_row_of_an_appliance_is_found_by_hash(spark, folder):
    text = queries.registered()["appliance_usage_map"](
        spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text


@pytest.mark.parametrize("name", ["households_by_ids", "label_encode", "pred_vs_actual"])
def test_data_rows_are_not_counted_in_one_task(spark, folder, name):
    text = queries.registered()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "GlobalLimit" not in text and "SinglePartition" not in text


def test_training_rows_are_made_once_for_all_models(spark, folder, monkeypatch):
    made, parts = [], queries._parts
    monkeypatch.setattr(queries, "_parts", lambda *a: made.append(a) or parts(*a))
    assert set(queries._models(spark, f"{folder}/")) == {"linear", "rf", "gbt"}
    assert len(made) == 1
