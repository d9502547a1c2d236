"""Plans at volume: columns pruned, sums combined before the shuffle, nothing paired with everything."""

import re

import pytest

from canopygrid.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def columns_read(text: str) -> set[str]:
    return {c.split(":")[0] for schema in re.findall(r"ReadSchema: struct<([^>\n]*)>", text) for c in schema.split(",")}


@pytest.mark.parametrize(
    "name,columns",
    [
        ("best_split_lineitem", {"l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"}),
        ("forest_predict", {"l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"}),
        ("node_histogram", {"l_returnflag", "l_linestatus"}),
        ("loss_mean_var", {"event_type", "value"}),
        ("random_split", {"doc_id"}),
    ],
)
def test_reads_only_its_columns(spark, name, columns):
    assert columns_read(plan(QUERIES[name](spark, FOLDER))) == columns


@pytest.mark.parametrize("name", ["best_split_lineitem", "normalized_gain", "node_histogram", "confusion_matrix", "forest_predict", "class_prior", "improve_histograms"])
def test_combines_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "partial_" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["tree_classify", "depth_normalize", "rgb_to_lab", "class_mapping", "random_split", "box_sum"])
def test_moves_nothing_it_needs_not(spark, name):
    """Projections have no shuffle at all; packed planes have the one that packs them."""
    text = plan(QUERIES[name](spark, FOLDER))
    assert text.count("Exchange hashpartitioning") <= {"box_sum": 1, "class_mapping": 1}.get(name, 0)


def test_no_pairs_of_everything(spark):
    for name in ("color_encode", "color_decode", "pad_grid", "five_runs", "trial_best", "reservoir_per_class", "pixel_uniform_accepted"):
        text = plan(QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_best_of_class_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["reservoir_per_class"](spark, FOLDER))
