"""Calibration of predicted risk, and a signal's portfolio through time, against plain loops over the same rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarterdeck.operators import backtest, research


def _end(k):
    y, m = divmod(1990 * 12 + k + 1, 12)
    return dt.date(y, m + 1, 1) - dt.timedelta(days=1)


def _panel(spark, n_months, n, seed=3):
    rng, rows = np.random.default_rng(seed), []
    style = rng.normal(size=n)
    for k in range(n_months):
        market, effect, sector = 0.04 * rng.normal(), 0.03 * rng.normal(), 0.02 * rng.normal(size=3)
        for i in range(n):
            x = float(style[i] + 0.3 * rng.normal())
            rows.append((_end(k), f"t{i:03d}", "abc"[i % 3], float(market + effect * x + sector[i % 3] + 0.06 * rng.normal()), x))
    return spark.createDataFrame(rows, "month date, ticker string, sector string, fwd double, style double"), pd.DataFrame(rows, columns=["month", "ticker", "sector", "fwd", "style"])


def test_draws_are_without_replacement_and_repeat(spark):
    names = spark.createDataFrame([(_end(k), f"t{i}") for k in range(3) for i in range(30 if k else 9)], "month date, ticker string")
    got = backtest.random_portfolios(names, 7, 5).toPandas()
    assert len(got) == 2 * 7 * 5 and not got.duplicated().any() and _end(0) not in set(got["month"])
    again = backtest.random_portfolios(names.repartition(5), 7, 5).toPandas()
    assert set(map(tuple, got.values)) == set(map(tuple, again.values))
    other = backtest.random_portfolios(names, 7, 5, seed=1).toPandas()
    assert set(map(tuple, got.values)) != set(map(tuple, other.values))


def test_predicted_risk_against_a_loop(spark):
    df, rows = _panel(spark, 12, 24)
    held = df.where(f"month = '{_end(9)}' and ticker < 't008'").select("month", F.lit(0).alias("draw"), "ticker", F.lit(0.125).alias("w"))
    (got,) = backtest.predicted_risk(held, df, ["style"], least=5).collect()
    earned, left = {}, []
    for month, g in rows.groupby("month"):
        share = np.array([(g["sector"] == s).mean() for s in "abc"])
        d = np.column_stack([(g["sector"] == s).to_numpy(float) for s in "abc"])
        x = np.column_stack([np.ones(len(g)), g["style"], d[:, :2] - np.outer(d[:, 2], share[:2] / share[2])])
        b = np.linalg.lstsq(x, g["fwd"].to_numpy(), rcond=None)[0]
        earned[month] = dict(zip(["market", "style", "a", "b", "c"], [*b, -b[2:] @ share[:2] / share[2]], strict=True))
        fit = b[0] + b[1] * g["style"] + g["sector"].map(earned[month])
        left.append(pd.DataFrame({"month": month, "ticker": g["ticker"], "u": g["fwd"] - fit}))
    left = pd.concat(left)
    past = [_end(k) for k in range(9)]
    w = np.array([0.5 ** ((8 - k) / 24) for k in range(9)])
    g = rows[(rows["month"] == _end(9)) & (rows["ticker"] < "t008")]
    y = np.array([np.mean([earned[m]["market"] + earned[m]["style"] * r.style + earned[m][r.sector] for r in g.itertuples()]) for m in past])
    factor = (w * y * y).sum() / w.sum() - ((w * y).sum() / w.sum()) ** 2
    own = left[left["month"].isin(past)].assign(w=lambda d: d["month"].map(dict(zip(past, w, strict=True))))
    v = own.assign(q=own["w"] * own["u"] ** 2).groupby("ticker")[["q", "w"]].sum().pipe(lambda d: d["q"] / d["w"])
    v = 9 / 21 * v + 12 / 21 * v.median()
    assert got.predicted == pytest.approx(np.sqrt(factor + (v[g["ticker"]] / 64).sum())) and got.realized == pytest.approx(g["fwd"].mean())


def test_bias_of_a_calibrated_panel_is_about_one(spark):
    df, _ = _panel(spark, 64, 60)
    got = {(r.kind, r.year): r for r in backtest.bias_statistic(df, ["style"], portfolios=6, size=20).collect()}
    assert got["random", None].n == 6 * 40 and 0.75 < got["random", None].bias < 1.3 and got["universe", None].n == 40
    louder = df.withColumn("fwd", F.when(F.col("month") > _end(50), F.col("fwd") * 3).otherwise(F.col("fwd")))
    turned = {(r.kind, r.year): r for r in backtest.bias_statistic(louder, ["style"], portfolios=6, size=20).collect()}
    assert turned["random", None].bias > 1.15 * got["random", None].bias
    assert backtest.bias_statistic(df.where(f"month < '{_end(20)}'"), ["style"], portfolios=2, size=20).count() == 0


def test_signal_backtest_against_a_loop(spark):
    rng = np.random.default_rng(5)
    tickers, months = [f"t{i:02d}" for i in range(40)], [_end(k) for k in range(10)]
    forms = [_end(0), _end(3), _end(6)]
    bench, signal = {}, {}
    for f in forms:
        names = [x for x in tickers if rng.random() < 0.9]
        v = rng.random(len(names))
        bench[f] = dict(zip(names, (v / v.sum()).tolist(), strict=True))
        signal[f] = {x: float(rng.normal()) for x in tickers if rng.random() < 0.95}
    returns = {(x, m): float(0.1 * rng.normal()) for x in tickers for m in months if rng.random() < 0.97}
    make = lambda rows, s: spark.createDataFrame(rows, s)
    monthly, log = backtest.signal_backtest(
        make([(f, x, w) for f in forms for x, w in bench[f].items()], "formation date, ticker string, w double"), make([(f, x, s) for f in forms for x, s in signal[f].items()], "month date, ticker string, s double"),
        make([(x, m, r) for (x, m), r in returns.items()], "ticker string, month date, r double"), make([(m,) for m in months], "month date"), cost=0.01, least=20)
    got, rows = {r.month: r for r in monthly.collect()}, {r.formation: r for r in log.collect()}
    old = None
    for k, f in enumerate(forms):
        end = forms[k + 1] if k + 1 < len(forms) else months[-1]
        uni = [x for x in bench[f] if x in signal[f]]
        total = sum(bench[f][x] for x in uni)
        b = {x: bench[f][x] / total for x in uni}
        top = sorted(uni, key=lambda x: (-signal[f][x], x))[: max(10, len(uni) // 10)]
        p = dict.fromkeys(top, 1 / len(top))
        turned = 1.0 if old is None else sum(abs(p.get(x, 0) - old.get(x, 0)) for x in {*p, *old}) / 2
        r = rows[f]
        assert (r.universe, r.names) == (len(uni), len(top)) and r.turnover == pytest.approx(turned) and r.drag == pytest.approx(0.02 * turned)
        act = pd.Series({x: p.get(x, 0) - b[x] for x in uni})
        assert r.transfer == pytest.approx(act.corr(pd.Series({x: signal[f][x] for x in uni})))
        assert r.active_share == pytest.approx(sum(abs(p.get(x, 0) - b[x]) for x in uni) / 2)
        ahead = {x: np.prod([1 + returns[x, m] for m in months if f < m <= end and (x, m) in returns]) - 1 for x in uni if any((x, m) in returns for m in months if f < m <= end)}
        s, a = pd.Series({x: signal[f][x] for x in ahead}).rank(), pd.Series(ahead).rank()
        assert r.realized_ic == pytest.approx(s.corr(a))
        for kind, w in (("portfolio", p), ("benchmark", b)):
            cur, first = dict(w), True
            for m in [m for m in months if f < m <= end]:
                cur = {x: v for x, v in cur.items() if (x, m) in returns}
                whole = sum(cur.values())
                gain = sum(v / whole * returns[x, m] for x, v in cur.items())
                assert got[m][kind] == pytest.approx(gain - (0.02 * turned if first and kind == "portfolio" else 0))
                cur, first = {x: v * (1 + returns[x, m]) for x, v in cur.items()}, False
            if kind == "portfolio":
                old = {x: v / sum(cur.values()) for x, v in cur.items()}
    assert len(got) == 9


def test_fundamental_law(spark):
    monthly = spark.createDataFrame([(_end(k), 0.02 + 0.01 * (k % 3), 0.01) for k in range(24)] + [(_end(24), None, 0.5)], "month date, portfolio double, benchmark double")
    log = spark.createDataFrame([(1, 100, 0.5, 0.10), (2, 200, 0.7, 0.20), (3, 300, 0.6, None)], "formation int, universe int, transfer double, realized_ic double")
    r = backtest.fundamental_law(monthly, log).first()
    a = pd.Series([0.01 + 0.01 * (k % 3) for k in range(24)])
    ir = a.mean() / a.std() * np.sqrt(12)
    assert r.ic == pytest.approx(0.15) and r.ic_t == pytest.approx(0.15 / (np.std([0.1, 0.2], ddof=1) / np.sqrt(2))) and r.breadth == 800 and r.ir_implied == pytest.approx(0.6 * 0.15 * np.sqrt(800))
    assert r.years == 2 and r.ir_actual == pytest.approx(ir) and r.ir_se == pytest.approx(np.sqrt((1 + ir * ir / 2) / 2)) and r.ir_t == pytest.approx(ir * np.sqrt(2))


def test_out_of_sample_keeps_the_first_betas(spark):
    rng = np.random.default_rng(8)
    f = {k: rng.normal(size=3) * 0.04 for k in range(30)}
    rows = []
    for s in range(8):
        start = s % 3
        for k in range(start, 30 if s else 14):
            beta = np.array([1.0 + 0.1 * s, 0.2, -0.1])
            rows.append((s, _end(k), float(0.001 * s + beta @ f[k] + 0.002 * rng.normal()), *map(float, f[k])))
    df = spark.createDataFrame(rows, "slug long, month date, y double, mkt_rf double, smb double, hml double")
    got = {r.month: r.managers for r in research.split_month(df, 10, 6).collect()}
    d = pd.DataFrame(rows, columns=["slug", "month", "y", "mkt_rf", "smb", "hml"])
    want = {}
    for m in sorted(set(d["month"])):
        n = sum((g["month"] < m).sum() >= 10 and (g["month"] >= m).sum() >= 6 for _, g in d.groupby("slug"))
        want |= {m: n} if n else {}
    assert got == want
    split = max(want, key=lambda m: (want[m], -m.toordinal()))
    later = research.out_of_sample(df, split, 10, 6).toPandas()
    first = {}
    for s, g in d.groupby("slug"):
        a, b = g[g["month"] < split], g[g["month"] >= split]
        if len(a) >= 10 and len(b) >= 6:
            x = np.column_stack([np.ones(len(a)), a[["mkt_rf", "smb", "hml"]]])
            beta = np.linalg.lstsq(x, a["y"].to_numpy(), rcond=None)[0]
            u = a["y"].to_numpy() - x @ beta
            se = np.sqrt(u @ u / (len(a) - 4) * np.linalg.inv(x.T @ x)[0, 0])
            own = later[later["slug"] == s].sort_values("month")
            assert np.allclose(own["u"], b["y"].to_numpy() - b[["mkt_rf", "smb", "hml"]].to_numpy() @ beta[1:]) and np.allclose(own["t1"], beta[0] / se) and np.allclose(own["alpha1"], 12 * beta[0])
            first[s] = beta[0] / se
    assert set(first) == set(later["slug"])
    groups = {r.group: r for r in research.out_of_sample_groups(spark.createDataFrame(later), 2).collect()}
    order = sorted(first, key=lambda s: -first[s])
    r = later[later["slug"].isin(order[:2])].groupby("month")["u"].mean() - later[later["slug"].isin(order[-2:])].groupby("month")["u"].mean()
    assert groups["best less worst"].alpha == pytest.approx(12 * r.mean()) and groups["best less worst"].t == pytest.approx(r.mean() / r.std() * np.sqrt(len(r)))
    assert groups["all"].managers == len(first) and groups["all"].rank_corr > 0.8 and groups["best"].alpha > groups["worst"].alpha
    assert research.out_of_sample_groups(spark.createDataFrame(later), 9).count() == 0
    assert research.split_month(df, 40, 6).count() == 0


def test_aggregate_book(spark):
    books = spark.createDataFrame([(1, _end(0), "a", 10.0), (2, _end(0), "a", 30.0), (1, _end(0), "b", 5.0), (1, _end(0), "c", 60.0), (2, _end(0), "c", 0.0), (1, _end(0), None, 9.0), (2, _end(0), None, 9.0)], "slug int, formation date, ticker string, value double")
    prices = spark.createDataFrame([("a", _end(0), 3.0), ("b", _end(0), 3.0), ("c", _end(0), 0.5)], "ticker string, month date, price double")
    assert [tuple(r) for r in backtest.aggregate_book(books, prices, least=2).collect()] == [(_end(0), "a", 1.0)]
