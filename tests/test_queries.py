"""Every core query gives the rows of its SQL."""

import pytest
from oracle import assert_same

from canopygrid.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert_same(QUERIES[name](spark, FOLDER), SQL[name], FOLDER)


@pytest.mark.parametrize("name", ["train_forest", "forest_label_pixels", "pixel_histograms"])
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_search_stops_a_hopeless_trial(spark):
    good, bad = sorted(QUERIES["hyper_search"](spark, FOLDER).collect())
    assert (good.status, good.runs, bad.status) == ("ok", 5, "stopped") and bad.runs < 5 and bad.true_loss is None
    assert good.true_loss is not None and good.loss < bad.loss


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
