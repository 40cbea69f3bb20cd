"""Filters and columns reach the scan; no window holds a whole table."""

import re

import pytest

from panelforge.queries import REGISTRY


def plan(name, spark, folder):
    return REGISTRY[name].run(spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["rank_in_month", "rank_all_lines", "minmax_scaling", "last_period", "green_index", "class_weights", "iqr_outliers"])
def test_rows_are_never_windowed_in_one_task(name, spark, folder):
    for window in re.findall(r"Window \[[^\n]*\n(?:[^\n]*\n){0,2}?[^\n]*Exchange SinglePartition", plan(name, spark, folder)):
        assert "_t" in window  # bucket totals only


def test_pushdown(spark, folder):
    text = plan("keep_codes", spark, folder)
    assert "In(o_orderstatus, [F,O])" in text and "o_totalprice" not in text
    assert "l_tax" not in plan("group_slope", spark, folder).split("ReadSchema")[1]
