"""Scale properties of physical plans, checked on the executed plans."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def _plan(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["prep_summary", "boxplot_stats", "knn_within_class", "smote", "concat_vectors",
                                 "prediction_distribution", "classification_report", "stratified_folds"])
def test_no_cartesian_or_nested_loop_join(spark, key):
    plan = _plan(spark, key)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key", ["balanced_sample", "first_n_per_group"])
def test_caps_use_partial_group_limit(spark, key):
    plan = _plan(spark, key)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_split_read_prunes_partitions(spark):
    plan = _plan(spark, "read_split")
    assert "PartitionFilters: [isnotnull(split" in plan and "(split#" in plan


def test_scoring_stays_in_the_jvm(spark):
    plan = _plan(spark, "score_linear")
    assert "EvalPython" not in plan and "ArrowEvalPython" not in plan


def test_filters_reach_the_scan(spark):
    plan = _plan(spark, "missing_profile")
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan


def test_unused_join_is_removed(spark):
    # only the label is needed: the orders aggregate and its join disappear
    plan = _plan(spark, "class_distribution")
    assert "orders.parquet" not in plan
