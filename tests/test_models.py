"""Models refitted along a calendar: embargo, planted signals, short tables, and the tree learner itself."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from quarterdeck.operators import models

TREES = {"rounds": 25, "eta": 0.2, "least": 5.0, "ridge": 1.0, "share": 1.0}


def _end(k):
    y, m = divmod(1990 * 12 + k + 1, 12)
    return dt.date(y, m + 1, 1) - dt.timedelta(days=1)


def _panel(spark, n_months, n, seed=0, change=None):
    rng, rows = np.random.default_rng(seed), []
    for k in range(n_months):
        for s in range(n):
            a, b = rng.normal(size=2)
            fwd = 0.05 * np.sign(a) + 0.02 * rng.normal()
            rows.append((s, _end(k), float(a), float(b) if s % 7 else None, float(fwd) * (change(k) if change else 1)))
    return spark.createDataFrame(rows, "slug long, month date, a double, b double, fwd_excess double")


def test_trees_find_steps_and_repeat():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    x[::9, 1] = np.nan
    y = np.where(x[:, 0] > 0.3, 1.0, 0.0) + np.where(np.nan_to_num(x[:, 1], nan=-9) > 0, 0.5, 0.0)
    made = models.boosted(x, y, 60, 0.3, 5.0, 1.0, 1.0, True)
    p = models.grown(x, *made[:3])
    assert np.abs(p - y).mean() < 0.1 and made[3][2] < 0.05 * made[3].sum()
    assert all((a == b).all() for a, b in zip(made, models.boosted(x, y, 60, 0.3, 5.0, 1.0, 1.0, True), strict=True))
    none = models.boosted(x[:4], y[:4], 5, 0.3, 50.0, 1.0, 1.0, True)  # nothing may be split
    assert (none[0] == -1).all() and np.isfinite(models.grown(x, *none[:3])).all()


def test_logistic_against_its_equations():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 2)) * [1, 30] + [0, 5]
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.4 + x[:, 0] - 0.02 * x[:, 1])))).astype(float)
    coef = models.logistic(x, y)
    p = 1 / (1 + np.exp(-(coef[0] + x @ coef[1:3])))
    assert abs((y - p).sum()) < 1e-6 and np.abs(x.T @ (y - p)).max() < 1e-5 and np.allclose(coef[3:], x.mean(axis=0))
    assert np.isnan(models.logistic(x, (x[:, 0] > 0).astype(float))).all()  # parted without a maximum


def test_back_and_schedule(spark):
    assert models._back(dt.date(2001, 2, 28), 12) == dt.date(2000, 2, 29) and models._back(dt.date(2001, 3, 15), 12) == dt.date(2000, 3, 15) and models._back(dt.date(2000, 12, 31), 12) == dt.date(1999, 12, 31)
    rows = spark.createDataFrame([(_end(k),) for k in range(20)], "month date")
    plan = models.schedule(rows, 12, 3)
    assert min(plan) == _end(14) and plan[_end(14)] == (_end(14), _end(2)) and len(plan) == 6
    every = models.schedule(rows, 0, 5, 4)
    assert [every[_end(k)][0] for k in range(5, 20)] == [_end(5 + 4 * ((k - 5) // 4)) for k in range(5, 20)]


def test_walk_forward_keeps_its_embargo_and_finds_the_signal(spark):
    short, long = 16, 24
    plain = _panel(spark, long, 40).selectExpr("*", "cast(fwd_excess < 0 as int) as y")
    turned = _panel(spark, long, 40, change=lambda k: -1 if k >= short - 12 + 1 else 1).selectExpr("*", "cast(fwd_excess < 0 as int) as y")
    run = lambda d: models.walk_forward(d, ["a", "b"], "a", trees={**TREES, "squared": False}, least=4).toPandas().sort_values(["month", "slug"])
    one, two = run(plain), run(turned)
    assert one["month"].min() == _end(15) and set(one["month"]) == {_end(k) for k in range(15, long)}
    at = _end(short)
    # labels less than a year old at the date don't change its scores; later on they do
    assert np.allclose(one[one.month == at][["logistic", "boosted"]].astype(float), two[two.month == at][["logistic", "boosted"]].astype(float))
    assert not np.allclose(one[one.month == _end(long - 1)]["logistic"], two[two.month == _end(long - 1)]["logistic"])
    assert np.corrcoef(one["boosted"], one["y"])[0, 1] > 0.8
    by = {r.model: r for r in models.evaluate(spark.createDataFrame(one), "fwd_excess").collect()}
    assert by["logistic"].auc_mean > 0.95 and by["boosted"].auc_pooled > 0.95 and by["boosted"].brier_skill > 0.5 and by["persist"].brier is None
    assert by["boosted"].spread_mean < -0.05 and by["boosted"].dates == long - 15 and by["boosted"].rows == len(one)
    dates = models.by_date(spark.createDataFrame(one), "fwd_excess").where("model = 'logistic'").toPandas().set_index("month")
    part = one[one.month == at].sort_values(["logistic", "slug"])
    assert np.isclose(dates.loc[at, "risky"], part["fwd_excess"].tail(8).mean()) and np.isclose(dates.loc[at, "safe"], part["fwd_excess"].head(8).mean())
    assert models.walk_forward(plain.where(f"month < '{_end(12)}'"), ["a", "b"], "a").count() == 0


def test_fits_stay_within_their_bound(spark):
    rows = _panel(spark, 20, 30).selectExpr("slug", "month", "a", "b", "cast(fwd_excess < 0 as int) as y")
    plan = models.schedule(rows, 12, 2)
    made = models.fits(rows, plan, ["a", "b"], "y", {**TREES, "squared": False}, True, most=60)
    assert len(made) == len(plan) and made["n_train"].between(25, 110).all()
    assert len(models.fits(rows.withColumn("y", models.F.lit(1)), plan, ["a", "b"], "y", {**TREES, "squared": False}, True)) == 0


def test_trees_by_month_use_earlier_months_only(spark):
    p = _panel(spark, 14, 60).selectExpr("slug as ticker", "month", "a", "b", "fwd_excess as fwd")
    later = p.withColumn("fwd", models.F.when(models.F.col("month") >= _end(9), -models.F.col("fwd")).otherwise(models.F.col("fwd")))
    run = lambda d: models.walk_forward_trees(d, ["a", "b"], first=6, every=3, trees={**TREES, "squared": True})
    one, two = (run(d)[0].toPandas().sort_values(["month", "ticker"]) for d in (p, later))
    early = one["month"] <= _end(9)
    assert one["month"].min() == _end(6) and np.allclose(one[early]["boosted"], two[(two["month"] <= _end(9))]["boosted"])
    assert not np.allclose(one["boosted"], two["boosted"])
    assert all(g["boosted"].rank().corr(g["fwd"].rank()) > 0.5 for _, g in one.groupby("month"))
    shares = run(p)[1].toPandas()
    assert sorted(set(shares["month"])) == [_end(6), _end(9), _end(12)] and (shares[shares.feature == "a"]["share"] > 0.8).all()
    assert run(p.where(f"month < '{_end(5)}'"))[0].count() == 0


def test_no_manager_is_in_its_own_fit(spark):
    rows = _panel(spark, 6, 50)
    # a manager's own label is its number's parity, which its feature tells: only a model that saw the manager could know
    own = rows.selectExpr("slug", "month", "cast(slug as double) as a", "b", "cast(slug % 2 as int) as y")
    got = models.out_of_fold(own, ["a"], trees={**TREES, "squared": False, "rounds": 80}).toPandas()
    assert len(got) == 300 and got.groupby("slug")["fold"].nunique().max() == 1 and set(got["fold"]) == set(range(5))
    assert np.corrcoef(got["boosted"], got["y"])[0, 1] < 0.2  # from its neighbours, which are of the other kind
    plain = models.out_of_fold(rows.selectExpr("slug", "month", "a", "b", "cast(fwd_excess < 0 as int) as y"), ["a", "b"], trees={**TREES, "squared": False})
    areas = {r.model: r for r in models.fold_areas(plain, "a").collect()}
    assert areas["logistic"].auc > 0.9 and areas["boosted"].auc > 0.9 and areas["persist"].managers == 50
    assert models.out_of_fold(own.limit(0), ["a"]).count() == 0


def test_head_to_head(spark):
    a = spark.createDataFrame([(1, 0.3), (2, 0.1), (3, 0.2), (5, 1.0)], "month int, ic double")
    b = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.1), (4, 1.0)], "month int, ic double")
    d = pd.Series([0.2, -0.1, 0.1])
    r = models.head_to_head(a, b, "month").first()
    assert (r.months, round(r.mean, 9), round(r.won, 9)) == (3, round(d.mean(), 9), round(2 / 3, 9)) and np.isclose(r.t, d.mean() / d.std() * np.sqrt(3))


def _long(spark, n, parts):
    """n rows of two features, one of them with ties, gaps and a step, over so many months."""
    k = "cast(id % 997 as double) / 997"
    frame = spark.range(n).selectExpr("id as slug", f"add_months(date '2001-01-31', cast(id % {parts} as int)) as month", f"{k} as a", "case when id % 13 > 0 then cast(id % 40 as double) end as b", f"cast({k} + 0.3 * (id % 7) / 7 > 0.6 as int) as y")
    frame = frame.withColumn("y", models.F.expr("if(pmod(xxhash64(slug), 10) < 2, 1 - y, y)"))
    return frame.withColumn("month", models.F.last_day("month"))


def test_a_fit_learns_from_every_row(spark):
    rows, at = _long(spark, 130_000, 4), dt.date(2002, 12, 31)
    trees = {**TREES, "squared": False, "rounds": 12}
    made = models.fits(rows, {at: (at, dt.date(2001, 4, 30))}, ["a", "b"], "y", trees, True).iloc[0]
    pdf = rows.toPandas()
    x, y = pdf[["a", "b"]].to_numpy(float), pdf["y"].to_numpy(float)
    assert made["n_train"] == len(y) and made["dates"] == 4 and np.isclose(made["base"], y.mean(), rtol=1e-12)
    assert np.allclose(made["coef"], models.logistic(x, y), rtol=1e-8)
    feature, cut, leaf, gain = models.boosted(x, y, **trees)
    assert (made["feature"] == feature.ravel()).all() and (made["cut"] == cut.ravel()).all()
    assert np.allclose(made["leaf"], leaf.ravel(), atol=1e-9) and np.allclose(made["gain"], gain, rtol=1e-6)


def test_edges_are_quantiles_of_all_values(spark, monkeypatch):
    monkeypatch.setattr(models, "PIECE_ROWS", 150)
    rows = _panel(spark, 6, 70, seed=3).selectExpr("slug", "month", "a", "case when slug % 3 = 0 then 0D else round(b, 1) end b", "cast(null as double) c", "1 as y")
    known = models._known(rows, ["a", "b", "c"], "y", models.F.unix_date("month")).cache()
    pdf = known.toPandas()
    groups = [frozenset(sorted(set(pdf["part"]))[:k]) for k in (1, 3, 6)]
    for g, got in zip(groups, models._edges(known, groups, ["a", "b", "c"], len(pdf)), strict=True):
        for c, e in zip("abc", got, strict=True):
            v = pdf[pdf["part"].isin(g)][c].dropna().to_numpy()
            assert (e == (np.unique(np.quantile(v, models.QUANTILES)) if len(v) else np.zeros(0))).all()


@pytest.mark.parametrize("latest", [True, False])
def test_scores_come_from_every_row_known(spark, latest):
    rows = _long(spark, 260_000, 13).select("*", models.F.lit(0.0).alias("fwd_excess"))
    late = rows.unionByName(rows.selectExpr("slug", "last_day(add_months(month, 12)) as month", "a", "b", "y", "fwd_excess").where("slug < 60"))
    got = models.walk_forward(late, ["a", "b"], "a", months=12, least=6, trees={**TREES, "squared": False, "rounds": 3}, latest=latest)
    last = got.groupBy().agg(models.F.max("month")).first()[0]
    got = got.where(models.F.col("month") == models.F.lit(last)).toPandas()
    known = late.where(models.F.col("month") <= models.F.lit(models._back(last, 12))).toPandas()
    coef = models.logistic(known[["a", "b"]].to_numpy(float), known["y"].to_numpy(float))
    x = got[["a", "b"]].to_numpy(float)
    want = 1 / (1 + np.exp(-(coef[0] + np.where(np.isfinite(x), x, coef[3:]) @ coef[1:3])))
    assert len(known) > 200_000 and len(got) and np.allclose(got["logistic"], want, rtol=1e-9) and np.isclose(got["base"].iloc[0], known["y"].mean(), rtol=1e-12)


def test_a_fold_learns_from_every_row_of_the_others(spark):
    rows = _long(spark, 160_000, 3)
    got = models.out_of_fold(rows, ["a", "b"], trees={**TREES, "squared": False, "rounds": 3}).toPandas()
    assert len(got) == 160_000
    for k, own in got.groupby("fold"):
        rest = got[got["fold"] != k]
        coef = models.logistic(rest[["a", "b"]].to_numpy(float), rest["y"].to_numpy(float))
        x = own[["a", "b"]].to_numpy(float)
        assert len(rest) > 110_000 and np.allclose(own["logistic"], 1 / (1 + np.exp(-(coef[0] + np.where(np.isfinite(x), x, coef[3:]) @ coef[1:3]))), rtol=1e-9)
