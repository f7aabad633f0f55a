"""Plan checks over every registered query: no cartesian products or nested-loop
joins; top-n windows run with a partial WindowGroupLimit; scans are pruned."""

import pytest

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"
SKIP = {"str_m1_dedupe_stream", "str_m2_daily_events_stream", "ds_16_ingest_new_rows", "ds_16_ingest_summary",
        "agg_5_regression_metrics", "ds_14_candidate_evaluation", "ds_15_promotion_gate", "join_14_side_by_side"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in E.queries() if n not in SKIP])
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(E.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_trailing_top_n_uses_partial_group_limit(spark):
    plan = _plan(E.queries()["join_7_trailing_news"](spark, SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_feature_scan_is_pruned(spark):
    df = E.queries()["ds_1_feature_panel"](spark, SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    # lineitem is read with the seven columns the bars need only
    assert "l_discount" not in text and "l_tax" not in text
