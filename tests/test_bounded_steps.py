"""Steps whose rows or tables are kept small on the way."""

import __spark_entry__ as entry
import pytest

from quarterdeck.operators import books


def test_lines_are_put_in_order_without_the_set_of_filings(spark):
    lines = spark.range(4).selectExpr("id % 2 slug", "last_day(add_months(date '2020-03-31', 3 * int(id))) period", "id cusip", "id * 5.0D shares", "id * 0.1D w_all")
    plan = books.link_quarters(lines.repartition("slug"))._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Sort [slug" in line and "cusip" in line)
    assert "collect_set" not in plan[at + 1]  # what is sorted has flags, no array for each line
    assert any("collect_set" in line for line in plan[at + 2 :])


@pytest.mark.parametrize("name", ["m04_walk_forward_dates", "m04_walk_forward_auc", "j22_watch_list"])
def test_models_are_asked_once_for_each_row(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan  # rows are scored before, and read again


def test_folds_are_scored_once(spark):
    plan = entry.queries()["m05_folds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan
