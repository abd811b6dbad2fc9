"""What Catalyst makes of the queries: pruned columns, pushed filters, no Python and no cross products in the hot path."""

import os
import re

import pytest

import __spark_entry__ as entry
from gridflow import catalog

SF = os.environ.get("GRIDFLOW_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: The sampler and the solver are sequential in each small group.
PYTHON = {"spaced_windows", "bounded_least_squares"}
#: One row of totals or bounds meets a table.
TOTALS = {"densify_grid", "forward_fill", "backward_fill", "interpolate_series", "interpolate_blend", "history_frame", "future_frame", "onset_ongoing", "spaced_windows", "weekly_profile_fallback", "attraction_share", "odme_score"}


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_python_and_no_products(spark, name):
    p = plan(spark, name)
    assert bool(re.search("Python|Pandas|Arrow", p)) == (name in PYTHON)
    assert "CartesianProduct" not in p and (name in TOTALS or "BroadcastNestedLoopJoin" not in p)


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "half_open_filter")
    assert "GreaterThanOrEqual(ts" in p and "LessThan(ts" in p
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "state_score"))
    assert read and not any("l_discount" in r or "p_name" in r or "s_acctbal" in r for r in read)


def test_windows_of_one_series_share_a_sort(spark):
    assert plan(spark, "interpolate_series").count("Exchange hashpartitioning(user_id") <= 3
