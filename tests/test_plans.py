"""Physical-plan properties of headline queries: no cartesian / nested-loop joins, and
parquet scans read only the columns the query needs."""

import re

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"
HEADLINE = ["v2_roc_auc", "v12_metric_set", "w7_global_rank", "r7_replicate_folds", "p13_attach",
            "a13_confusion_by_run", "j2_keep_samples", "n4_geno_filter", "t8_resample_table"]


def _plan(spark, name):
    df = queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HEADLINE)
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_lineitem_scan_is_pruned(spark):
    plan = _plan(spark, "v2_roc_auc")
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert scans, plan
    for cols in scans:  # 11 lineitem columns exist; the AUC needs three
        assert len(cols.split(",")) <= 4, cols
