"""Lines of the books: added up once and looked up where they lie, with the same result as by way of holdings."""

import datetime as dt

import pytest

from quarterdeck.operators import books
from quarterdeck.plans import holdings, testbed


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_lines_are_added_up_once_and_looked_up_where_they_lie(spark):
    tb = testbed.Testbed(spark, "/root/testdata/sf0.001")
    plan = planned(holdings.books(tb))
    assert sum("HashAggregate(" in x for x in plan) == 2  # one sum, in part and whole
    assert sum("ShuffledHashJoin" in x for x in plan) == 1 and not any("SortMergeJoin" in x or "Broadcast" in x for x in plan)
    assert sum("Window [" in x for x in plan) == 3  # filings, managers, lines
    plan = planned(tb.prices)
    assert sum("ShuffledHashJoin" in x for x in plan) == 1 and not any("SortMergeJoin" in x or "Broadcast" in x for x in plan)


def test_long_book_equals_the_build_of_holdings(spark, tmp_path):
    at, part = dt.datetime(2000, 2, 3), [(1, "a", "B", "T"), (1, "a", "B", "T"), (2, "b", "B", "U"), (2, "c", "A", "V"), (20, "d", "B", "T"), (3, None, "B", None)]
    lines = [
        (1, 1, 5.0, 10.0, 0.0, "N", at), (1, 1, 2.0, 4.0, 0.0, "N", at), (1, 2, 5.0, 3.0, 0.0, "N", dt.datetime(2000, 3, 31, 23)), (1, 20, 1.0, 7.0, 0.085, "R", at), (1, 9, 1.0, 7.0, 0.0, "N", at),
        (2, 1, 1.0, 9.0, 0.09, "R", at), (2, 2, 1.0, 9.0, 0.09, "A", at), (2, 2, 1.0, 9.0, None, "A", at), (2, 3, 1.0, 9.0, 0.09, None, at), (2, 3, 1.0, -2.0, 0.0, "N", at),
        (3, 1, 1.0, -9.0, 0.0, "N", at), (3, 2, 1.0, 0.0, 0.0, "N", at), (3, 3, 1.0, 5.0, 0.0, "N", at), (3, 3, 1.0, -5.0, 0.0, "N", at), (3, 20, None, 4.0, 0.0, "N", dt.datetime(2000, 4, 1)), (4, 20, 1.0, None, 0.0, "N", at),
        (None, 1, 1.0, 6.0, 0.0, "N", at), (4, None, 1.0, 6.0, 0.0, "N", at), (11, 1, 1.0, 6.0, 0.0, "N", None), (11, 20, 1.0, 6.0, 0.0, "N", dt.datetime(2000, 12, 31)),
    ]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    tb = testbed.Testbed(spark, str(tmp_path))
    columns = ["slug", "period", "cusip", "value", "shares", "filed", "ticker"]
    rows = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    got = rows(holdings.long_book(tb))
    assert got == rows(books.map_tickers(books.build(tb.holdings), tb.cusip_map))
    q = dt.date(2000, 3, 31)
    assert {(1, q, 1): (28.0, 14.0, "B/T"), (1, q, 2): (6.0, 10.0, "A/V"), (2, q, 2): (18.0, 2.0, "A/V"), (2, q, 3): (7.0, 2.0, None)}.items() <= {r[:3]: (*r[3:5], r[6]) for r in got}.items()
    assert not any(r[0] == 3 and r[1] == q for r in got) and (1, 9) not in {(r[0], r[2]) for r in got}


def test_books_of_long_lines_equal_those_of_holdings(spark):
    tb = testbed.Testbed(spark, "/root/testdata/sf0.001")
    old = books.load(tb.holdings, tb.cusip_map).drop("name")
    new = holdings.books(tb).select(*old.columns)
    order = ["slug", "period", "cusip"]
    a, b = old.orderBy(*order).collect(), new.orderBy(*order).collect()
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert all((u == pytest.approx(v)) if isinstance(u, float) else u == v for u, v in zip(x, y))
