"""Steps whose work must grow no faster than their tables: once through the lines, few exchanges, the same rows as before."""

import datetime as dt
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarterdeck.operators import books, models, research, risk, signals
from quarterdeck.plans import holdings, testbed

QUARTERS = [dt.date(2000, 3, 31), dt.date(2000, 6, 30), dt.date(2000, 9, 30), dt.date(2000, 12, 31), dt.date(2001, 3, 31)]
FORMED = [dt.date(2000, 5, 31), dt.date(2000, 8, 31), dt.date(2000, 11, 30), dt.date(2001, 2, 28), dt.date(2001, 5, 31)]


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_books_read_the_lines_once_and_deal_them_twice(spark):
    plan = planned(holdings.books(testbed.Testbed(spark, "/root/testdata/sf0.001")))
    assert sum("FileScan" in x and "lineitem" in x for x in plan.splitlines()) == 1
    assert sum("Exchange hashpartitioning" in x for x in plan.splitlines()) <= 3  # lines, the map of cusips, books


def test_formation_weights_by_a_plain_loop(spark):
    rng, rows = np.random.default_rng(8), []
    for slug in range(9):
        for q in range(5):
            if rng.random() < 0.8:  # a quarter can be missing
                rows += [(slug, QUARTERS[q], QUARTERS[q], f"c{k}", "", float(rng.integers(1, 50)), float(rng.integers(1, 9)), "n") for k in rng.permutation(12)[: rng.integers(4, 9)]]
    h = spark.createDataFrame(rows, "slug long, period date, filed date, cusip string, putcall string, value double, shares double, name string")
    names = spark.createDataFrame([(f"c{k}", f"t{k % 7}") for k in range(11)], "cusip string, ticker string")  # c11 has none
    got = {(r.portfolio, r.formation, r.ticker): r.w for r in books.formation_weights(books.position_counts(books.load(h, names))).collect()}

    book = defaultdict(dict)
    for slug, period, _, cusip, _, value, shares, _ in rows:
        book[slug, QUARTERS.index(period)][cusip] = (value, shares)
    book = {k: v for k, v in book.items() if len(v) >= 5}
    n, ticker = Counter(), lambda c: None if c == "c11" else f"t{int(c[1:]) % 7}"
    for (slug, q), held in book.items():
        order = sorted(held, key=lambda c: (-held[c][0], c))
        before, after = book.get((slug, q - 1)), book.get((slug, q + 1))
        for c in filter(ticker, held):
            was = before and before.get(c)
            in_ = {"ALL": True, "BEST1": order.index(c) < 1, "BEST3": order.index(c) < 3, "NEW": before is not None and was is None, "ADD": was and held[c][1] >= 1.25 * was[1], "CUT": was and held[c][1] <= 0.75 * was[1]}
            n.update((p, FORMED[q], ticker(c)) for p, yes in in_.items() if yes)
            if after is not None and c not in after:
                n["SOLD", FORMED[q + 1], ticker(c)] += 1
    for q in range(5):
        lines = [(slug, ticker(c), v[0]) for (slug, at), held in book.items() if at == q for c, v in held.items() if ticker(c)]
        by = sorted((len({s for s, u, _ in lines if u == t}), sum(v for _, u, v in lines if u == t), t) for t in {t for _, t, _ in lines})
        n.update(("CROWD_HI" if 5 * i // len(by) == 4 else "CROWD_LO", FORMED[q], t) for i, (_, _, t) in enumerate(by) if 5 * i // len(by) in (0, 4))
    total = Counter()
    for (p, f, _), k in n.items():
        total[p, f] += k
    assert got == pytest.approx({key: k / total[key[:2]] for key, k in n.items()}) and {p for p, *_ in got} == set(books.PORTFOLIOS)


def test_clone_returns_by_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    ends = [(dt.date(2000, 1, 1) + dt.timedelta(days=32 * k)).replace(day=1) - dt.timedelta(days=1) for k in range(1, 14)]
    r = {(f"t{t}", m): None if rng.random() < 0.1 else float(rng.normal(0, 0.1)) for t in range(7) for m in ends}
    priced = {k for k in r if rng.random() < 0.9}
    filed = {(s, q): ends[q] - dt.timedelta(days=int(rng.integers(0, 20))) for s in range(6) for q in (0, 3, 4, 9) if rng.random() < 0.8}
    rows = [(s, ends[q], d, f"t{t}", float(rng.integers(1, 9)) / 20) for (s, q), d in filed.items() for t in rng.integers(0, 7, 6)]
    frame = spark.createDataFrame
    prices = frame([(t, m, 1.0) for t, m in sorted(priced)], "ticker string, month date, price double")
    paths = signals.holding_paths(prices, frame([(t, m, v) for (t, m), v in r.items()], "ticker string, month date, r double"), frame([(m,) for m in ends], "month date"))
    bk = frame(rows, "slug long, period date, filed date, ticker string, w double")
    df = signals.clone_returns(bk, paths, floor=0.3, least=2)
    got = {(x.slug, x.month): (x.r, x.coverage, x.names) for x in df.collect()}
    want = {}
    for s in range(6):
        mine = sorted(q for (x, q) in filed if x == s)
        for q in mine:
            w = defaultdict(float)
            for _, period, _, t, v in (x for x in rows if x[0] == s and x[1] == ends[q] and (x[3], ends[q]) in priced):
                w[t] += v
            live, share = dict(w), sum(w.values())
            for k in range(q + 1, min([q + 4, *[x for x in mine if x > q][:1], 12]) + 1):
                if not live:
                    break
                ok = {t: v for t, v in live.items() if r[t, ends[k]] is not None}
                there = sum(ok.values()) / sum(live.values()) if ok else None
                cover = there and there * share
                back = sum(v * r[t, ends[k]] for t, v in ok.items()) / sum(ok.values()) if ok and cover >= 0.3 and len(ok) >= 2 else None
                want[s, ends[k]] = (back, cover, len(ok))
                live = {t: v * (1 + r[t, ends[k]]) for t, v in ok.items()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want) and any(v[0] for v in want.values())


def test_price_fingerprints_and_line_ends_by_plain_loops(spark):
    rng, frame = np.random.default_rng(6), spark.createDataFrame
    walk = lambda: np.exp(np.cumsum(rng.normal(0, 0.2, 5)))
    there = lambda: [q for q in range(5) if rng.random() < 0.9]
    lines, prices = ({f"{x}{k}": {q: v for q, v in enumerate(walk())} for k in range(9)} for x in "ct")
    lines, prices = ({k: {q: v[q] for q in there()} for k, v in d.items()} for d in (lines, prices))
    rows = lambda d: [(k, QUARTERS[q], float(v)) for k, x in d.items() for q, v in x.items()]
    df = research.price_fingerprints(frame(rows(lines), "cusip string, period date, implied double"), frame(rows(prices), "ticker string, period date, price double"), least=2, gap=0.3)
    steps = lambda x: {q: np.log(x[q] / x[q - 1]) for q in x if q - 1 in x}
    want = {}
    for c, x in lines.items():
        gaps = []
        for t, y in prices.items():
            a, b = steps(x), steps(y)
            both = [abs(a[q] - b[q]) for q in a if q in b]
            if len(both) >= 2:
                gaps.append((float(np.quantile(both, 0.9)), t, len(both)))
        if gaps:
            gaps = sorted(gaps)
            want[c] = (gaps[0][1], gaps[0][2], gaps[0][0], gaps[1][0] if len(gaps) > 1 else None)
    got = {r.cusip: (r.ticker, r.quarters, r.gap, r.runner_up_gap) for r in df.collect()}
    assert set(got) == set(want) and all(got[k][:2] == want[k][:2] and got[k][2:] == pytest.approx(want[k][2:]) for k in want)
    assert "percentile" not in planned(df)  # a pair is one row, whatever its quarters

    held = {(s, q, c) for s, q, c in rng.integers(0, 5, (40, 3)).tolist()}
    edges = books.line_ends(frame([(s, QUARTERS[q], c) for s, q, c in held] + [(1, QUARTERS[0], None)], "slug long, period date, cusip long"))
    of = {c: [q for _, q, d in held if d == c] for _, _, c in held}
    assert {(r.slug, QUARTERS.index(r.period), r.cusip, r.starts, r.ends) for r in edges.collect()} == {(s, q, c, q == min(of[c]), q == max(of[c])) for s, q, c in held if q in (min(of[c]), max(of[c]))}


def test_bootstrap_fits_each_draw_once(monkeypatch):
    rng, calls, plain = np.random.default_rng(1), [], risk._alphas
    y, x = rng.normal(0, 1, (5, 40)), rng.normal(0, 1, (5, 40))
    assert plain(y, x, 0.3)[1] == pytest.approx(plain(y - 0.3, x)[1]) and (plain(y, x, 0.3)[0] == plain(y, x)[0]).all()
    monkeypatch.setattr(risk, "_resampled", lambda aligned, work, fields, seed: work(y[0], x[0], rng))
    monkeypatch.setattr(risk, "_alphas", lambda *a: calls.append(a) or plain(*a))
    risk.bootstrap(None, replicates=20)
    assert len(calls) == 2  # the record, and its draws


def test_only_the_latest_date_is_fitted(spark, monkeypatch):
    rng, asked, fits = np.random.default_rng(2), [], models.fits
    ends = [(dt.date(2000, 1, 1) + dt.timedelta(days=32 * k)).replace(day=1) - dt.timedelta(days=1) for k in range(1, 9)]
    panel = spark.createDataFrame([(s, m, float(rng.normal()), int(rng.integers(0, 2))) for s in range(30) for m in ends], "slug long, month date, a double, y int")
    monkeypatch.setattr(models, "fits", lambda rows, plan, *a, **k: asked.extend(plan) or fits(rows, plan, *a, **k))
    run = lambda latest: models.walk_forward(panel, ["a"], "a", months=1, least=3, trees={**models.CLASSED, "rounds": 3}, latest=latest).where(f"month = '{ends[-1]}'").orderBy("slug").collect()
    last = run(True)
    assert asked == [ends[-1]] and last == run(False) and len(last) == 30
