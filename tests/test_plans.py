import pytest

from quillframe.plans import ORACLES, QUERIES
from quillframe.session import temporary_conf

FOLDER = "/root/testdata/sf0.001"


def test_every_answer_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", [
    "group_median", "multi_group_mean", "group_extremes", "profile_top_values", "remap_ids", "chart_box",
    "upsert_latest", "delete_by_key", "driver_segments", "feat_frequency", "ml_roc",
])
def test_no_pairing_of_rows_in_the_plan(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_values_are_cut_before_the_shuffle(spark):
    plan = QUERIES["profile_top_values"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_filters_reach_the_scan(spark):
    # The plan's text abbreviates what a scan tells of itself beyond this length.
    with temporary_conf(spark, spark__sql__maxMetadataStringLength="5000"):
        plan = QUERIES["filter_eq_gt_lt"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    assert all(name in pushed for name in ("EqualTo(l_returnflag", "GreaterThan(l_quantity", "LessThan(l_discount"))
