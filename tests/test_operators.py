"""Hand-worked values of single operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterdeck.functions import columns as c
from quarterdeck.operators import books, composite, research, risk, signals, statements
from quarterdeck.sources import readers

D = dt.date
STATEMENT = "statement_id string, account_id string, period_start date, period_end date, beginning_value double, ending_value double, stated_deposits double, stated_withdrawals double, stated_pnl double, stated_return_pct double"
FLOW = "account_id string, date date, amount double, flow_type string"
POSITION = "statement_id string, account_id string, as_of_date date, market_value double"


def reconcile(spark, sts, flows=(), positions=()):
    st = spark.createDataFrame([(*s, None, None, None, None) for s in sts], STATEMENT)
    fl = spark.createDataFrame([(*f, "deposit") for f in flows], FLOW)
    return statements.reconcile(st, fl, spark.createDataFrame(list(positions), POSITION)), fl


def year(i, y, begin, end, account="A"):
    return (i, account, D(y, 1, 1), D(y, 12, 31), begin, end)


def test_dietz_chain_break_gap_and_status(spark):
    rec, _ = reconcile(spark, [year("1", 2001, 1000.0, 1200.0), year("2", 2002, 1205.0, 1300.0), year("3", 2004, None, 1400.0)], [("A", D(2001, 7, 2), 100.0)])
    got = {r.statement_id: r for r in rec.collect()}
    assert got["1"].dietz_return == pytest.approx(100 / (1000 + 100 * 182 / 365))
    assert "CHAIN_BREAK" in got["2"].flags and got["2"].status == "flagged"
    assert {"PERIOD_GAP", "NO_BEGINNING_VALUE"} <= set(got["3"].flags) and got["3"].dietz_return is None and got["3"].status == "unverified"


def test_inferred_beginning_is_no_check(spark):
    rec, _ = reconcile(spark, [year("1", 2001, None, 100.0), year("2", 2002, None, 110.0)])
    got = {r.statement_id: r for r in rec.collect()}
    assert got["1"].status == got["2"].status == "unverified"
    assert got["2"].dietz_return == pytest.approx(0.10) and "INFERRED_BEGINNING" in got["2"].flags


@pytest.mark.parametrize("a,b,same", [(100.0, 100.99, True), (100.0, 101.01, False), (1e6, 1000099.0, True), (1e6, 1000101.0, False), (None, 1.0, False)])
def test_tolerance(spark, a, b, same):
    assert spark.createDataFrame([(a, b)], "a double, b double").select(c.matches(F.col("a"), F.col("b")).alias("m")).first().m is same


def test_inception_and_closing_periods(spark):
    rec, fl = reconcile(spark, [year("1", 2001, 0.0, 1050.0), year("2", 2002, 1000.0, 0.0, "B")], [("A", D(2001, 7, 2), 1000.0), ("B", D(2002, 4, 1), -1100.0)])
    got = {r.statement_id: r for r in statements.period_returns(rec, fl).collect()}
    assert got["1"].r == pytest.approx(50 / (1000 * 182 / 183)) and not got["1"].full_period
    assert got["2"].r == pytest.approx(0.10) and got["2"].eff_end == D(2002, 4, 1)


def test_orphan_flow(spark):
    rec, fl = reconcile(spark, [year("1", 2001, 100.0, 110.0), year("2", 2003, None, 120.0)], [("A", D(2002, 5, 5), 7.0)])
    assert statements.orphan_flows(rec, fl).count() == 1


def test_segments_break_on_gap_and_flag(spark):
    rows = [(str(y), "A", D(y, 1, 1), D(y, 12, 31), r, e) for y, r, e in ((2001, 0.1, "verified"), (2002, 0.1, "verified"), (2004, 0.1, "verified"), (2005, 0.1, "flagged"), (2006, 0.2, "verified"))]
    df = spark.createDataFrame(rows, "statement_id string, account_id string, eff_start date, eff_end date, r double, evidence string")
    sizes = sorted(r["count"] for r in statements.segments(df).groupBy("segment").count().collect())
    assert sizes == [1, 1, 2]
    assert {r.statement_id for r in statements.longest_segment(statements.segments(df)).collect()} == {"2001", "2002"}


def test_xirr(spark):
    rows = [("a", D(2001, 1, 1), -100.0), ("a", D(2002, 1, 1), -100.0), ("a", D(2003, 1, 1), 231.0), ("b", D(2001, 1, 1), 5.0)]
    got = {r.k: r.irr for r in statements.xirr(spark.createDataFrame(rows, "k string, date date, amount double"), "k").collect()}
    assert got["a"] == pytest.approx(0.10, abs=1e-3) and got["b"] is None


def test_fee_path(spark):
    df = spark.createDataFrame([(i, r, 1.0) for i, r in enumerate([0.20, -0.10, 0.10, 0.05])], "o int, gross double, years double")
    got = [r.model_net for r in composite.model_net(df, "o", mgmt=0.0).orderBy("o").collect()]
    assert got == pytest.approx([0.16, -0.10, 0.10, 1.196656 / 1.1484 - 1])


def test_longest_run_is_truncated_at_holes(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.1), (3, None), (4, 0.5), (5, 0.5), (6, 0.5)], "i int, r double").withColumn("k", F.lit(1))
    assert sorted(r.i for r in composite.longest_run(df, "i", "r", "k").collect()) == [4, 5, 6]


def month(y, m):
    return D(y, m, 28) if m == 2 else D(y, m, 30 if m in (4, 6, 9, 11) else 31)


def test_drawdown_and_tail(spark):
    s = spark.createDataFrame([(1, month(2001, i + 1), r) for i, r in enumerate([0.10, -0.20, -0.25, 0.50])], "k int, month date, r double")
    assert risk.drawdowns(s, "r", "k").agg(F.min("drawdown")).first()[0] == pytest.approx(0.8 * 0.75 - 1)
    ten = [-0.10, -0.05, -0.02, 0.0, 0.01, 0.02, 0.03, 0.05, 0.06, 0.08]
    t = risk.tail_risk(spark.createDataFrame([(1, x) for x in ten] + [(2, 0.1), (2, 0.2)], "k int, r_p double"), "k")
    got = {r.k: r for r in t.collect()}
    assert got[1].var_hist == pytest.approx(float(np.percentile(ten, 5))) and got[1].shortfall == pytest.approx(-0.10) and got[2].var_hist is None


def test_formation_date(spark):
    got = spark.createDataFrame([(D(2020, 3, 31),), (D(2020, 12, 31),)], "p date").select(c.formation_date(F.col("p")).alias("f")).collect()
    assert [r.f for r in got] == [D(2020, 5, 31), D(2021, 2, 28)]


def test_conviction_flags_and_late_filers(spark):
    q1, q2 = D(2020, 3, 31), D(2020, 6, 30)
    rows = [(1, q1, D(2020, 5, 1), x, x, "", 10.0, 100.0) for x in "ABCEF"] + [(1, q2, D(2020, 8, 1), x, x, "", 10.0, 150.0 if x == "B" else 100.0) for x in "ABDEF"] + [(2, q1, D(2020, 6, 15), x, x, "", 1.0, 1.0) for x in "ABCDE"]
    h = spark.createDataFrame(rows, "slug int, period date, filed date, cusip string, name string, putcall string, value double, shares double")
    bk = books.load(h, spark.createDataFrame([(x, x) for x in "ABCDEF"], "cusip string, ticker string"))
    got = {r.cusip: r for r in bk.where(F.col("period") == F.lit(q2)).collect()}
    assert got["B"].add and got["D"].new and not got["A"].add and not got["A"].new
    assert [r.cusip for r in books.sold(bk).collect()] == ["C"] and bk.where("slug = 2").count() == 0


def test_price_guard_and_missing_month(spark):
    rows = [("x", month(2001, 1), 2.0), ("x", month(2001, 2), 10.0), ("y", month(2001, 1), 50.0), ("y", month(2001, 2), 300.0), ("z", month(2001, 1), 1.0), ("z", month(2001, 3), 1.1)]
    got = {(r.ticker, r.month): r for r in signals.clean_returns(spark.createDataFrame(rows, "ticker string, month date, price double")).collect()}
    assert got[("x", month(2001, 2))].r is None and got[("x", month(2001, 2))].spike and got[("y", month(2001, 2))].r == 5.0 and len(got) == 2


def test_drift_equals_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    months = [month(2001, m) for m in range(1, 7)]
    r = {(t, m): (None if t == "C" and m == months[3] else float(rng.normal(0, 0.1))) for t in "ABC" for m in months}
    w = spark.createDataFrame([("p", D(2000, 12, 31), t, 1 / 3) for t in "ABC"], "portfolio string, formation date, ticker string, w double")
    rets = spark.createDataFrame([(t, m, x) for (t, m), x in r.items()], "ticker string, month date, r double")
    ms = spark.createDataFrame([(m,) for m in months], "month date")
    got = {(x.ticker, x.month): x.weight for x in signals.drifted(w, rets, signals.spells(w, ms, "portfolio").select("portfolio", "formation", "month"), "portfolio").collect()}
    cur = dict.fromkeys("ABC", 1 / 3)
    for m in months:
        cur = {t: x for t, x in cur.items() if r[(t, m)] is not None}
        total = sum(cur.values())
        for t in cur:
            assert got[(t, m)] == pytest.approx(cur[t] / total)
        cur = {t: x * (1 + r[(t, m)]) for t, x in cur.items()}


def test_auc(spark):
    s = spark.createDataFrame([(k, y, x) for k, ys in {"up": (0, 0, 1, 1), "down": (1, 1, 0, 0), "one": (1, 1, 1, 1)}.items() for y, x in zip(ys, (1.0, 2.0, 3.0, 4.0), strict=True)] + [("ties", y, 1.0) for y in (0, 1, 1)], "k string, y int, s double")
    assert {r.k: r.auc for r in risk.auc(s, "y", "s", "k").collect()} == {"up": 1.0, "down": 0.0, "ties": 0.5, "one": None}


def test_as_of_knows_only_what_was_filed_and_forgets_the_stale(spark):
    facts = spark.createDataFrame([("x", D(2021, 5, 10), D(2021, 3, 31), 1.0), ("x", D(2020, 2, 1), D(2019, 12, 31), 2.0)], "ticker string, filed date, end date, value double")
    q = spark.createDataFrame([("x", D(2021, 3, 31)), ("x", D(2021, 5, 31)), ("x", D(2022, 12, 31)), ("x", D(2020, 3, 31))], "ticker string, t date")
    assert {r.t: r.value for r in signals.as_of(q, facts).collect()} == {D(2021, 3, 31): 2.0, D(2021, 5, 31): 1.0, D(2022, 12, 31): None, D(2020, 3, 31): 2.0}


def test_share_counts_lose_outliers_and_splits(spark):
    v = [100.0, 101.0, 101000.0, 102.0, 103.0, 412.0, 413.0, 414.0]
    df = spark.createDataFrame([("x", D(2001 + i, 1, 1), x) for i, x in enumerate(v)], "ticker string, end date, value double")
    got = [r.value for r in signals.clean_shares(df).orderBy("end").collect()]
    assert got == pytest.approx([400.0, 404.0, 408.0, 412.0, 412.0, 413.0, 414.0])


def test_cross_section_recovers_planted_returns(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        s, x = "ab"[i % 3 == 0], float(rng.normal())
        rows.append((month(2001, 1), f"t{i}", s, x, 0.005 + 0.02 * x + (0.01 if s == "a" else -0.02)))
    df = spark.createDataFrame(rows, "month date, ticker string, sector string, style double, fwd double")
    got = {r.factor: r.ret for r in signals.cross_sections(df, ["style"]).collect()}
    assert got["style"] == pytest.approx(0.02) and got["market"] == pytest.approx(0.005) and got["ind:a"] == pytest.approx(0.01) and got["ind:b"] == pytest.approx(-0.02)


def test_risk_split(spark):
    w = spark.createDataFrame([("p", "a", 0.5), ("p", "b", 0.5)], "portfolio string, ticker string, w double")
    x = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 1.0)], "ticker string, factor string, x double")
    cov = spark.createDataFrame([("m", "m", 0.0004)], "i string, j string, v double")
    sp = spark.createDataFrame([("a", 0.0009), ("b", 0.0016)], "ticker string, v double")
    r = signals.decompose(w, x, cov, sp).first()
    assert r.factor_risk == pytest.approx(math.sqrt(0.0004 * 12)) and r.specific_risk == pytest.approx(math.sqrt((0.25 * 0.0009 + 0.25 * 0.0016) * 12))


def test_student_and_hac():
    assert risk.student_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-6) and risk.student_p(0.0, 5) == pytest.approx(1.0)
    x = np.column_stack([np.ones(50), np.arange(50.0)])
    y = np.random.default_rng(0).normal(size=50)
    beta, se, u, _ = risk.ols(x, y, 0)
    inv = np.linalg.inv(x.T @ x)
    assert se == pytest.approx(np.sqrt(np.diag(inv @ (x.T * u**2) @ x @ inv))) and beta == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0])


def test_infotable_xml_and_csv(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<informationTable><infoTable><nameOfIssuer>Foo Inc</nameOfIssuer><titleOfClass>COM</titleOfClass><cusip>00ab</cusip><value>1,200</value><shrsOrPrnAmt><sshPrnamt>30</sshPrnamt></shrsOrPrnAmt><putCall>Put</putCall></infoTable></informationTable>")
    r = readers.read_infotables(spark, str(tmp_path / "a.xml")).first()
    assert (r.cusip, r.name, r.value, r.shares, r.putcall) == ("00AB", "Foo Inc", 1200.0, 30.0, "put")
    (tmp_path / "flows.csv").write_text("account_id,date,amount,flow_type\nA,2001-02-03,\"$1,000.50\",deposit\nB,bad, ,\n")
    got = readers.read_table(spark, str(tmp_path / "flows.csv"), "flows").orderBy("account_id").collect()
    assert got[0].amount == 1000.5 and got[0].date == D(2001, 2, 3) and got[1].date is None and got[1].amount is None and got[1].description is None
    assert readers.load_dataset(spark, str(tmp_path), ("flows", "accounts"))["accounts"].count() == 0


def test_a_late_filing_of_an_old_period_hides_nothing(spark):
    facts = spark.createDataFrame([("x", D(2021, 2, 20), D(2020, 12, 31), 1.0), ("x", D(2021, 3, 1), D(2019, 6, 30), 9.0)], "ticker string, filed date, end date, value double")
    q = spark.createDataFrame([("x", D(2021, 3, 31)), ("x", D(2021, 2, 1)), ("x", D(2023, 1, 1)), ("y", D(2021, 3, 31))], "ticker string, t date")
    assert {(r.ticker, r.t): r.value for r in signals.as_of(q, facts).collect()} == {("x", D(2021, 3, 31)): 1.0, ("x", D(2021, 2, 1)): None, ("x", D(2023, 1, 1)): None, ("y", D(2021, 3, 31)): None}


def test_found_rates_leave_no_value(spark):
    import random

    rng, rows = random.Random(3), []
    for k in range(60):
        flows = [(k, D(2000 + rng.randrange(8), 1 + rng.randrange(12), 5), -rng.uniform(1, 100)) for _ in range(6)]
        rows += flows + [(k, D(2009, 6, 30), -sum(a for *_, a in flows) * rng.uniform(0.3, 3))]
    got = {r.k: r.irr for r in statements.xirr(spark.createDataFrame(rows, "k long, date date, amount double"), "k").collect()}
    for k, rate in got.items():
        own = [(d, a) for key, d, a in rows if key == k]
        first = min(d for d, _ in own)
        worth = [a / (1 + rate) ** ((d - first).days / 365.25) for d, a in own]
        assert abs(sum(worth)) < 1e-9 * sum(map(abs, worth))
    assert len(got) == 60


def test_pooled_area_is_that_of_all_pairs(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.randrange(2), float(rng.randrange(40))) for _ in range(500)] + [(None, 1.0), (1, None)]
    own = [r for r in rows if None not in r]
    pos, neg = [s for y, s in own if y], [s for y, s in own if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    for n in (1, 7, 256):
        r = risk.auc_pooled(spark.createDataFrame(rows, "y int, s double"), "y", "s", n).first()
        assert r.n == 500 and abs(r.auc - want) < 1e-12


def test_resamples_find_planted_skill(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0.005, 0.04, 96)
    rows = [(name, D(2000 + i // 12, i % 12 + 1, 28), float(a + 0.9 * x[i] + e), float(x[i])) for name, a in (("good", 0.01), ("none", 0.0)) for i, e in enumerate(rng.normal(0, 0.01, 96))]
    df = spark.createDataFrame(rows, "slug string, month date, y double, y_b double")
    b = {r.slug: r for r in risk.bootstrap(df).collect()}
    y = np.array([r[2] for r in rows[:96]])
    design = np.column_stack([np.ones(96), x])
    beta, se = risk.ols(design, y)[:2]
    assert abs(b["good"].t_observed - beta[0] / se[0]) < 1e-6 and b["good"].n == 96
    assert b["good"].p_one_sided < 0.01 < b["none"].p_two_sided and b["good"].alpha_low < beta[0] < b["good"].alpha_high and b["good"].alpha_low > 0
    again = {r.slug: r for r in risk.bootstrap(df.repartition(3)).collect()}
    assert again == b
    c = {r.slug: r for r in risk.null_cohort(df).collect()}
    assert c["good"].percentile > 0.99 and 0.0 < c["none"].percentile < 1.0


def test_sleeves_skip_gaps_and_cash_earns_the_rate(spark):
    px = [("A", D(2020, 1, 31), 10.0), ("A", D(2020, 2, 29), 11.0), ("A", D(2020, 4, 30), 12.0), ("A", D(2020, 5, 31), None), ("B", D(2020, 1, 31), 1.0), ("B", D(2020, 2, 29), 2.0)]
    prices = spark.createDataFrame(px, "ticker string, month date, price double")
    rf = spark.createDataFrame([(D(2020, 3, 31), 0.002)], "month date, rf double")
    got = research.sleeve_returns(prices, spark.createDataFrame([("stocks", "A"), ("bonds", "none")], "sleeve string, ticker string"), rf)
    assert sorted((r.sleeve, r.month, round(r.r, 9)) for r in got.collect()) == [("cash", D(2020, 3, 31), 0.002), ("stocks", D(2020, 2, 29), 0.1)]


def test_home_weight_is_found_from_earlier_years_only(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key, share in (("mixed", 0.6), ("beyond", 1.4)):
        for i, (h, a) in enumerate(rng.normal(0, 0.04, (30, 2)).tolist()):
            w = share if i < 24 else 0.1  # a change in the third year isn't known at its start
            rows.append((key, D(2020 + i // 12, i % 12 + 1, 28), w * h + (1 - w) * a, h, a))
    rows.append(("short", D(2020, 1, 28), 0.1, 0.1, 0.2))
    got = research.home_weights(spark.createDataFrame(rows, "key string, month date, world double, home double, abroad double"), "key").collect()
    assert sorted((r.key, r.year, r.home and round(r.home, 9)) for r in got) == [
        ("beyond", 2020, None), ("beyond", 2021, 1.0), ("beyond", 2022, 1.0), ("mixed", 2020, None), ("mixed", 2021, 0.6), ("mixed", 2022, 0.6), ("short", 2020, None)]


def test_curves_carry_gaps_and_end_at_a_total_loss(spark):
    rows = [("a", 1, None), ("a", 2, 0.1), ("a", 3, None), ("a", 4, 0.2), ("b", 1, 0.5), ("b", 2, -1.0), ("b", 3, 0.5)]
    df = spark.createDataFrame([(k, D(2020, n, 28), r) for k, n, r in rows], "k string, month date, r double")
    got = [(x.k, x.month.month, x.growth and round(x.growth, 9), x.total and round(x.total, 9)) for x in research.curves(df, "k", "r").orderBy("k", "month").collect()]
    assert got == [("a", 1, None, None), ("a", 2, 1.1, 0.1), ("a", 3, 1.1, 0.1), ("a", 4, 1.32, 0.3), ("b", 1, 1.5, 0.5), ("b", 2, 0.0, -0.5), ("b", 3, 0.0, 0.0)]


def test_second_search_is_kept_only_where_the_first_is_silent(spark):
    prints = spark.createDataFrame([(1, "AA", True), (2, "BB", False), (3, "CC", True)], "cusip long, ticker string, accepted boolean")
    moves = spark.createDataFrame([(1, 10, 2, 3), (1, 11, 3, 3), (2, 20, 1, 1), (4, 41, 2, 2), (4, 40, 2, 2)], "cusip long, now long, moved long, holders long")
    got = sorted((r.cusip, r.ticker, r.accepted, r.how, r.now, r.corroborated) for r in research.merged_matches(prints, moves).collect())
    assert got == [(1, "AA", True, "price path", 11, True), (2, "BB", False, "price path", 20, True), (3, "CC", True, "price path", None, False), (4, None, True, "holder migration", 40, True)]
