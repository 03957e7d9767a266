"""Steps that grow with the tables: worked out once for a query, and in tasks of bounded size."""

import datetime as dt
from itertools import combinations

import __spark_entry__ as entry
import numpy as np
import pytest

from quarterdeck.operators import books, signals
from quarterdeck.streaming import jobs

ONCE = ["k10_formation_weights", "k11_turnover", "k12_clone_returns", "k19_backtest_summary", "r22_portfolio_summary", "r23_spreads", "r30_cost_sensitivity", "r18_out_of_sample", "o04_half_sample_ranks", "a13_account_performance", "a35_leaderboard", "p17_verdicts"]
FITTED = ["m03_boosted_walk_forward", "m04_walk_forward_dates", "m05_folds", "j22_watch_list"]


@pytest.mark.parametrize("name", [*ONCE, *FITTED])
def test_the_large_table_is_gone_through_once(spark, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert not [f for f in df.inputFiles() if "lineitem" in f or "orders" in f]  # only tables made of it are read again


def test_holder_pairs_in_tasks_of_bounded_size(spark):
    rng = np.random.default_rng(2)
    held = sorted({(int(s), int(c)) for s, c in rng.integers(0, 12, (70, 2))})
    got = books.holder_pairs(spark.createDataFrame([*held, (3, None)], "slug long, cusip long"), rows=20)
    by = {s: {c for t, c in held if t == s} for s, _ in held}
    want = {(a, b): len(by[a] & by[b]) for a, b in combinations(sorted(by), 2) if by[a] & by[b]}
    assert {(r.a, r.b): r.names for r in got.collect()} == want
    assert got.rdd.getNumPartitions() >= sum(want.values()) / 20
    assert books.holder_pairs(spark.createDataFrame([], "slug long, cusip long")).count() == 0


def test_as_of_with_many_facts_of_a_day(spark):
    rng, day = np.random.default_rng(3), dt.date(2020, 1, 1)
    facts = []
    for _ in range(400):
        end = day + dt.timedelta(days=int(rng.integers(0, 900)))
        facts.append(("x", end + dt.timedelta(days=int(rng.integers(0, 60)) * 7), end, float(rng.integers(0, 1000))))
    ask = [day + dt.timedelta(days=k) for k in range(0, 1500, 11)]
    got = signals.as_of(spark.createDataFrame([("x", t) for t in ask], "ticker string, t date"), spark.createDataFrame(facts, "ticker string, filed date, end date, value double"), stale_days=200).collect()
    for r in got:
        known = [(f, e, v) for _, f, e, v in facts if f <= r.t and e >= r.t - dt.timedelta(days=200)]
        assert (r.value, r.end) == (max(known)[2], max(known)[1]) if known else r.value is None
    assert len(got) == len(ask)


def test_chain_check_of_accounts_that_share_a_state(spark, tmp_path):
    rng, day, rows = np.random.default_rng(5), dt.date(2020, 1, 1), []
    for k in range(120):
        account, at = int(rng.integers(0, 9)), int(rng.integers(0, 10))
        end = None if k == 50 else day + dt.timedelta(days=30 * at + 29)
        rows.append((None if account == 8 else account, f"s{k:03}", day + dt.timedelta(days=30 * at - int(rng.integers(0, 2)) * 3), end, None if rng.random() < 0.2 else float(rng.choice([100, 100.5, 103])), 100.0))
    schema = "account_id long, statement_id string, period_start date, period_end date, beginning_value double, ending_value double"
    for part in (rows[:60], rows[60:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.statement_id: (r.account_id, r.broken, r.gap_days) for r in jobs.run_to_files(jobs.chain_check(stream, states=2), "append", f"file://{tmp_path}").collect()}
    want, last = {}, {}
    for part in (rows[:60], rows[60:]):
        for a, s, start, end, begin, ending in sorted(part, key=lambda r: (r[3] or dt.date.max, r[1])):
            broken = gap = None
            if end is not None and a in last and end > last[a][0]:
                gap = (start - last[a][0]).days - 1
                broken = abs(begin - last[a][1]) > 1 if gap == 0 and begin is not None else None
            if end is not None and (a not in last or end > last[a][0]):
                last[a] = end, ending
            want[s] = a, broken, gap
    assert got == want and {True, False, None} == {b for _, b, _ in got.values()}
