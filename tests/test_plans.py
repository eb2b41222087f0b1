"""What the plans of the main queries must and must not hold."""

import pytest

from polyview.plans import QUERIES
from tests.helpers import plan


@pytest.fixture(scope="module")
def plans(spark, sf):
    cache = {}

    def get(name):
        if name not in cache:
            cache[name] = plan(QUERIES[name](spark, sf))
        return cache[name]

    return get


def test_routed_prediction_shuffles_nothing(plans):
    text = plans("routed_predict")
    assert "Exchange" not in text
    assert text.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in text
    assert "Window" not in text


@pytest.mark.parametrize("name", ["ablation_sweep", "gate_sweep"])
def test_sweeps_score_once(plans, name):
    text = plans(name)
    assert text.count("ArrowEvalPython") == 1
    assert text.count("FileScan") == 1


@pytest.mark.parametrize(
    "name",
    ["bin_score", "code_to_label", "label_to_id_strict", "split_hash", "softmax_rows", "prompt_identity", "path_basename"],
)
def test_row_local_queries_have_no_shuffle(plans, name):
    assert "Exchange" not in plans(name)


@pytest.mark.parametrize("name", sorted(set(QUERIES)))
def test_no_cross_joins(plans, name):
    text = plans(name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_bucketed_views_are_grouped_without_a_shuffle(plans):
    text = plans("views_concat_bucketed")
    assert "Exchange" not in text and "Bucketed: true" in text
    assert "Exchange" in plans("views_concat")


def test_catalog_is_broadcast(plans):
    assert "BroadcastHashJoin" in plans("expert_lookup")


def test_columns_are_pruned(plans):
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plans("bin_score")
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plans("path_basename")


def test_filters_reach_the_scan(plans):
    assert "EqualTo(role,user)" in plans("prompt_train")
