"""Facts as filed: share counts made usable, several facts as of a month, and the watch list of the latest date."""

import datetime as dt
import math

import pytest

from quarterdeck.operators import models, research, signals

D = dt.date


def test_usable_shares(spark):
    ends = [D(2000 + k // 4, 3 * (k % 4) + 1, 28) for k in range(12)]
    rows = [("a", e, e + dt.timedelta(40), 100.0 + k, "10-Q") for k, e in enumerate(ends)]
    rows[5] = ("a", ends[5], rows[5][2], 105_000.0, "10-Q")  # a thousandfold, once
    rows += [("a", ends[7], ends[7] + dt.timedelta(90), 200.0, "10-Q/A"), ("a", ends[8], None, None, "10-Q"), ("b", ends[0], ends[1], 5.0, "20-F")]
    # a split of two from the seventh end on: what was before is doubled
    rows += [("c", e, e, 10.0 if k < 6 else 20.0, "10-K") for k, e in enumerate(ends)] + [("d", e, e, 1.0 if k < 5 else 30.0 * 1.9**k, "10-K") for k, e in enumerate(ends)]
    got = signals.usable_shares(spark.createDataFrame(rows, "ticker string, end date, filed date, value double, form string")).collect()
    a = {r.end: r for r in got if r.ticker == "a"}
    assert len(a) == 11 and ends[5] not in a and a[ends[7]].filed == ends[7] + dt.timedelta(90)
    assert {r.value for r in got if r.ticker == "c"} == {20.0} and not [r for r in got if r.ticker == "b"]
    d = sorted(r.value for r in got if r.ticker == "d")
    assert len(d) < 12 and d[-1] <= 20 * 20 * d[0]


def test_facts_as_of_and_signals(spark):
    q, start = D(2001, 3, 31), D(2000, 4, 1)
    rows = [("a", "equity", None, q, D(2001, 5, 5), 50.0, "10-Q"), ("a", "equity", None, q, D(2001, 8, 5), 60.0, "10-Q/A"), ("a", "assets", None, q, D(2001, 5, 5), 200.0, "10-Q"), ("a", "shares", None, q, D(2001, 5, 5), 10.0, "10-Q")]
    rows += [("a", "net_income", start, q, D(2001, 5, 5), 8.0, "10-Q"), ("a", "net_income", D(2001, 1, 1), q, D(2001, 5, 5), 2.0, "10-Q"), ("a", "op_cf", start, q, D(2001, 5, 5), -4.0, "10-Q"), ("b", "assets", None, q, D(2001, 5, 5), -1.0, "10-Q"), ("b", "net_income", start, q, D(2001, 5, 5), 1.0, "10-Q")]
    facts = spark.createDataFrame(rows, "ticker string, fact string, start date, end date, filed date, value double, form string")
    months = [D(2001, 4, 30), D(2001, 5, 31), D(2001, 8, 31), D(2002, 6, 30), D(2002, 7, 31)]
    closes = spark.createDataFrame([(t, m, 4.0) for t in "ab" for m in months], "ticker string, month date, close double")
    got = {(r.ticker, r.month): r for r in signals.fundamental_signals(closes, facts).collect()}
    assert len(got) == 10
    r = got["a", months[1]]
    assert r.size == pytest.approx(-math.log(40)) and (r.value, r.profitability, r.cash_flow, r.earnings_yield) == (50 / 40, 0.04, -0.02, 0.2)
    assert got["a", months[2]].value == 1.5 and got["a", months[3]].value == 1.5
    assert all(got[t, m][k] is None for t, m in (("a", months[0]), ("a", months[4]), ("b", months[1])) for k in signals.FUNDAMENTAL)
    assert signals.fundamental_signals(closes.limit(0), facts).count() == 0


def test_watch_list(spark):
    scored = spark.createDataFrame([(1, D(2000, 1, 31), 0.9, 0.9), (1, D(2000, 2, 29), 0.2, 0.5), (2, D(2000, 2, 29), 0.2, 0.7), (3, D(2000, 2, 29), None, 0.1), (4, D(2000, 2, 29), 0.6, 0.7)], "slug long, month date, logistic double, boosted double")
    names = spark.createDataFrame([(1, "one", "ls"), (2, "two", "lo"), (4, "four", "fo")], "slug long, manager string, style string")
    got = {r.slug: r for r in models.watch_list(scored, names).collect()}
    assert {k: (r.rank_boosted, r.rank_logistic) for k, r in got.items()} == {2: (1, 2.5), 4: (2, 1.0), 1: (3, 2.5), 3: (4, None)}
    assert got[1].manager == "one" and got[3].manager is None and len(got) == 4


def test_error_census(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    quarter = [D(2000, 3, 31), D(2000, 6, 30), D(2000, 9, 30), D(2000, 12, 31)]
    values = {1: [5.0, 5000.0, 5.2, 5.1], 2: [7.0, 7.1, 7100.0, 7200.0], 3: [1.0, 30.0, 0.0, 900.0]}
    books = make([(s, q, v / 2) for s, vs in values.items() for q, v in zip(quarter, vs, strict=True) for _ in range(2)], "slug int, period date, value double")
    ends = [D(2000 + k // 4, 3 * (k % 4) + 1, 28) for k in range(10)]
    shares = [("a", e, e, 100.0 if k != 4 else 100_000.0, "10-Q") for k, e in enumerate(ends)] + [("b", e, e, 10.0 if k < 6 else 20.0, "10-K") for k, e in enumerate(ends)] + [("c", ends[0], ends[0], 5.0, "20-F")]
    renames = make([("x", True), ("y", False)], "cusip string, accepted boolean")
    lines = make([("x", None), ("y", None), ("z", "T"), ("y", None)], "cusip string, ticker string")
    spikes = make([(True,), (False,), (None,)], "spike boolean")
    census = lambda *t: {r.issue: (r.cases, r.both_sides) for r in research.error_census(*t).collect()}
    tables = books, make(shares, "ticker string, end date, filed date, value double, form string"), renames, lines, spikes
    assert census(*tables) == {"unit of book values": (3, 1), "split basis of share counts": (1, None), "dropped share counts": (2, None), "renamed lines": (1, None), "lines without a price": (1, None), "impossible returns": (1, None)}
    assert set(census(*[t.limit(0) for t in tables]).values()) == {(0, 0), (0, None)}
