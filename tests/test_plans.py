"""Plan shape: equi joins, pruned scans, pushed filters."""

import pytest

import __spark_entry__ as entry

from conftest import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j7_already_saved", "j7_not_saved", "j10_open_line_owners", "m4_save_if_absent", "j4_job_read", "f10_private_addresses"])
def test_no_nested_loop(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["f3_favourites"](spark, DATA))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_row_wise_jobs_do_not_shuffle_by_key(spark):
    assert "hashpartitioning" not in plan(entry.queries()["t15_structured_recipes"](spark, DATA))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_folder_orders(spark):
    from larder.operators.catalog import folder_order

    names = spark.createDataFrame([("b",), ("Batch",), ("a",), ("é",)], "name string")
    assert [r["name"] for r in folder_order(names).collect()] == ["Batch", "a", "b", "é"]
    assert [r["name"] for r in folder_order(names, by_bytes=False).collect()] == ["a", "b", "Batch", "é"]
