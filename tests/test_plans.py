"""How often the plans of some queries read their tables, and what they shuffle."""

import os
import re

import pytest

from prefloom.plans import catalog

SF = "/root/testdata/sf0.001"
SCANS = {"e10_judged_counts": 2, "p2_split_exact": 1, "w13_hierarchical": 2, "r13_masked_mean": 1, "s7_write_tree": 1, "r11_masked_whiten": 2, "d9_collate": 2}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(SCANS))
def test_scans(name, spark):
    assert len(re.findall(r"Scan (?:parquet|text)", plan_of(catalog.QUERIES[name](spark, SF)))) <= SCANS[name]


@pytest.mark.parametrize("name", ["r11_masked_whiten", "r20_train_stats", "d9_collate", "d10_reward_collate", "d20_pad_batch"])
def test_arrays_are_not_shuffled_by_batch(name, spark):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(catalog.QUERIES["q7_task_status"](spark, SF))
    assert "PushedFilters: [In(event_type, [click,error])]" in plan or "In(event_type" in plan
    assert "props" not in plan
