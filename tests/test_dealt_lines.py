"""Queries on more order lines than a session's few tasks should hold."""

import pytest

import __spark_entry__ as entry
from shelfline.sources import star
from tests.oracle_check import compare, connect

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["duplicate_grains", "stockout_impact", "feature_stockout"])
def test_a_task_holds_no_more_lines_of_a_larger_table(spark, monkeypatch, name):
    monkeypatch.setattr(star, "TASK_ROWS", 500)
    tasks = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)
    df = entry.queries()[name](spark, DATA)
    dealt = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "REPARTITION_BY_NUM" in line]
    assert tasks > 4 and dealt and all(f", {tasks})" in line for line in dealt)
    assert compare(df, connect(DATA), entry.oracle_sql()[name]) is None


def test_promotions_are_matched_once_for_levels_factors_and_result(spark, no_broadcast):
    df = entry.queries()["expected_demand"](spark, DATA)
    assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert compare(df, connect(DATA), entry.oracle_sql()["expected_demand"]) is None
