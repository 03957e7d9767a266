"""Across managers and models: blends, diversification, rename recovery, attribution, walk-forward classifiers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .risk import average_rank, ols, record_pairs


def blend_stats(weights: DataFrame, alphas: DataFrame, cov: DataFrame) -> DataFrame:
    """Alpha, residual risk and information ratio of each blend: sums and a quadratic form by two joins.

    weights(blend, slug, w), alphas(slug, alpha), cov(a, b, v) with both orders and the diagonal.
    """
    mean = weights.join(alphas, "slug").groupBy("blend").agg(F.sum(F.col("w") * F.col("alpha")).alias("alpha"), F.count("*").alias("n"))
    x = weights.select("blend", F.col("slug").alias("a"), F.col("w").alias("wa"))
    z = weights.select("blend", F.col("slug").alias("b"), F.col("w").alias("wb"))
    risk = x.join(cov, "a").join(z, ["blend", "b"]).groupBy("blend").agg(F.sqrt(F.greatest(F.sum(F.col("wa") * F.col("wb") * F.col("v")), F.lit(0.0))).alias("risk"))
    return mean.join(risk, "blend").withColumn("ir", F.try_divide("alpha", "risk"))


def covariance_rows(series: DataFrame, value: str = "u", shrink: float = 0.5) -> DataFrame:
    """(a, b, v) of all pairs over common months, in both orders, and of each with itself; off the diagonal shrunk by half."""
    pairs = record_pairs(series, value, diagonal=True, wanted=("covar",), both_orders=True)
    return pairs.select("a", "b", F.when(F.col("a") == F.col("b"), F.col("covar")).otherwise(F.col("covar") * (1 - shrink)).alias("v"))


def diversification(alphas: DataFrame, residuals: DataFrame, most: int = 25) -> DataFrame:
    """Equal blends of the first n managers by alpha, n = 1 to most. Only their covariances are worked out.

    alphas(slug, alpha), residuals(slug, month, u).
    """
    best = alphas.orderBy(F.desc("alpha"), "slug").limit(most).withColumn("k", F.row_number().over(Window.orderBy(F.desc("alpha"), "slug")))
    spread = best.withColumn("blend", F.explode(F.sequence(F.col("k"), F.lit(most)))).withColumn("w", 1.0 / F.col("blend"))
    return blend_stats(spread.select("blend", "slug", "w"), best.select("slug", "alpha"), covariance_rows(residuals.join(F.broadcast(best.select("slug")), "slug")))


def half_sample_ranks(first: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """Mean later alpha of the k best and worst managers by earlier t. first(slug, t), second(slug, later)."""
    known = first.where("t is not null")
    ends = [known.orderBy(F.desc("t"), "slug").limit(k).select("slug", F.lit("best").alias("group")), known.orderBy("t", "slug").limit(k).select("slug", F.lit("worst").alias("group"))]
    return ends[0].unionByName(ends[1]).join(second, "slug").groupBy("group").agg(F.count("*").alias("n"), F.avg("later").alias("later"))


def split_month(aligned: DataFrame, first: int = 36, last: int = 24) -> DataFrame:
    """(month, managers): how many have first months before it and last months from it on, for every month that may split.

    A manager serves from the month after its first-th to its last-th from the end: a step up and a step down, which are
    added up along the months.
    """
    w = Window.partitionBy("slug")
    placed = aligned.select("slug", "month").distinct().withColumn("k", F.row_number().over(w.orderBy("month"))).withColumn("n", F.count("*").over(w))
    ends = placed.where(F.col("n") >= first + last).groupBy("slug").agg(F.max(F.when(F.col("k") == first, F.col("month"))).alias("after"), F.max(F.when(F.col("k") == F.col("n") - last + 1, F.col("month"))).alias("until"))
    steps = ends.select(F.date_add("after", 1).alias("at"), F.lit(1).alias("step")).unionByName(ends.select(F.date_add("until", 1).alias("at"), F.lit(-1).alias("step"))).groupBy("at").agg(F.sum("step").alias("step"))
    months = aligned.select(F.col("month").alias("at")).distinct().withColumn("step", F.lit(0))
    run = months.withColumn("kind", F.lit(1)).unionByName(steps.withColumn("kind", F.lit(0)))
    total = F.sum("step").over(Window.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))  # a few rows for each month
    return run.withColumn("managers", total).where("kind = 1 and managers > 0").select(F.col("at").alias("month"), "managers")


def out_of_sample(aligned: DataFrame, split, first: int = 36, last: int = 24) -> DataFrame:
    """(slug, month, alpha1, t1, u): each month from the split on, net of the betas of the months before it.

    y on the three factors, plain errors; alpha1 is yearly. Managers with fewer months on either side are left out. A
    manager's rows are months of one record: a group of bounded size.
    """
    factors = ["mkt_rf", "smb", "hml"]
    schema = f"slug {aligned.schema['slug'].dataType.simpleString()}, month date, alpha1 double, t1 double, u double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        a, b = pdf[pdf["month"] < split], pdf[pdf["month"] >= split]
        if len(a) < first or len(b) < last:
            return pd.DataFrame(columns=["slug", "month", "alpha1", "t1", "u"], dtype=object)
        beta, se, *_ = ols(np.column_stack([np.ones(len(a)), a[factors].to_numpy(float)]), a["y"].to_numpy(float), None)
        u = b["y"].to_numpy(float) - b[factors].to_numpy(float) @ beta[1:]
        return pd.DataFrame({"slug": b["slug"], "month": b["month"], "alpha1": beta[0] * 12, "t1": beta[0] / se[0] if se[0] > 0 else None, "u": u})

    return aligned.select("slug", "month", "y", *factors).dropna().groupBy("slug").applyInPandas(run, schema)


def out_of_sample_groups(later: DataFrame, k: int = 10) -> DataFrame:
    """(group, managers, months, first_alpha, alpha, vol, t, rank_corr, positive): the k best and worst by t1, best less worst, and all.

    Monthly means over a group's managers of out_of_sample(); rank_corr is that of first and later alphas over all
    managers, positive the share of later ones above nothing. With fewer than 2 k managers there are no rows.
    """
    one = later.groupBy("slug").agg(F.max("t1").alias("t1"), F.max("alpha1").alias("alpha1"), (12 * F.avg("u")).alias("alpha2"))
    count = one.agg(F.count("*").alias("candidates"))
    best, worst = one.orderBy(F.desc_nulls_last("t1"), "slug").limit(k), one.orderBy(F.asc_nulls_first("t1"), F.desc("slug")).limit(k)
    groups = best.select("slug", F.lit("best").alias("group")).unionByName(worst.select("slug", F.lit("worst").alias("group"))).unionByName(one.select("slug", F.lit("all").alias("group")))
    rows = later.join(groups, "slug")
    sizes = groups.join(one, "slug").groupBy("group").agg(F.count("*").alias("managers"), F.avg("alpha1").alias("first_alpha"))
    monthly = rows.groupBy("group", "month").agg(F.avg("u").alias("r"))
    gap = monthly.where("group = 'best'").select("month", "r").join(monthly.where("group = 'worst'").select("month", F.col("r").alias("w")), "month").select(F.lit("best less worst").alias("group"), "month", (F.col("r") - F.col("w")).alias("r"))
    stats = monthly.unionByName(gap).groupBy("group").agg(F.count("*").alias("months"), (12 * F.avg("r")).alias("alpha"), (F.stddev_samp("r") * math.sqrt(12)).alias("vol"), F.try_divide(F.avg("r"), F.stddev_samp("r") / F.sqrt(F.count("*"))).alias("t"))
    ranks = one.withColumn("a", average_rank("alpha1")).withColumn("b", average_rank("alpha2")).agg(F.corr("a", "b").alias("rank_corr"), F.avg((F.col("alpha2") > 0).cast("double")).alias("positive"))
    return stats.join(sizes, "group", "left").join(count.where(F.col("candidates") >= 2 * k), how="inner").join(ranks, how="inner").select("group", "managers", "months", "first_alpha", "alpha", "vol", "t", "rank_corr", "positive")  # one row each


def blend_returns(returns: DataFrame, weights: DataFrame, fee: float = 0.0) -> DataFrame:
    """Monthly-rebalanced and drifting returns of blends(blend, slug, w), with a yearly fee taken monthly, and the months all hold."""
    j = returns.join(weights, "slug").withColumn("net", F.col("r") - fee / 12)
    size = weights.groupBy("blend").agg(F.count("*").alias("k"))
    common = j.groupBy("blend", "month").agg(F.count("*").alias("n")).join(size, "blend").where("n = k").select("blend", "month")
    rows = j.join(common, ["blend", "month"])
    back = Window.partitionBy("blend", "slug").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    grown = rows.withColumn("g", F.col("w") * F.coalesce(F.product(1 + F.col("net")).over(back), F.lit(1.0)))
    return grown.groupBy("blend", "month").agg((F.sum(F.col("w") * F.col("net")) / F.sum("w")).alias("rebalanced"), (F.sum(F.col("g") * F.col("net")) / F.sum("g")).alias("drifting"), (F.sum(F.col("w") * (F.col("r") - F.col("net"))) / F.sum("w")).alias("fee_drag"))


def check_targets(series: DataFrame, value: str, *key: str, ret: float = 0.05, vol: float = 0.2, sharpe: float = 0.3) -> DataFrame:
    """Whether each series meets yearly targets."""
    s = series.groupBy(*key).agg(F.count("*").alias("months"), (12 * F.avg(value)).alias("ret"), (math.sqrt(12) * F.stddev_samp(value)).alias("vol"))
    return s.withColumn("ok_return", F.col("ret") >= ret).withColumn("ok_vol", F.col("vol") <= vol).withColumn("ok_sharpe", F.try_divide("ret", "vol") >= sharpe)


def price_fingerprints(lines: DataFrame, prices: DataFrame, least: int = 8, gap: float = 0.02) -> DataFrame:
    """The ticker whose price path each unmapped line follows, if it is near and the runner-up is not.

    lines(cusip, period, implied), prices(ticker, period, price), a row for each quarter. Each path of quarterly log
    changes is one row, bounded by the calendar, and so is each pair; the gap of a pair is the 90th percentile of their
    absolute differences over common quarters. Lines and tickers with few quarters are left out first.
    """
    w = lambda k: Window.partitionBy(k).orderBy("period")
    change = lambda d, k, c: d.where(F.col(c) > 0).select(k, "period", (F.log(c) - F.log(F.lag(c).over(w(k)))).alias("d"), F.lag("period").over(w(k)).alias("before")).where("d is not null and before = last_day(add_months(period, -3))")
    path = lambda d, k: d.groupBy(k).agg(F.collect_list(F.struct("period", "d")).alias("path"))
    a = path(change(lines, "cusip", "implied"), "cusip").where(F.size("path") >= least).select("cusip", F.map_from_entries("path").alias("at"))
    b = path(change(prices, "ticker", "price"), "ticker").where(F.size("path") >= least).select("ticker", "path")
    apart = F.transform("path", lambda x: F.abs(F.try_element_at("at", x["period"]) - x["d"]))
    pairs = a.crossJoin(b).select("cusip", "ticker", F.array_sort(F.filter(apart, lambda x: x.isNotNull())).alias("apart")).withColumn("quarters", F.size("apart").cast("long")).where(F.col("quarters") >= least)
    place = (F.col("quarters") - 1) * F.lit(0.9)
    below = F.floor(place)
    value = lambda k: F.element_at("apart", (k + 1).cast("int"))
    between = (below + 1 - place) * value(below) + (place - below) * value(F.least(below + 1, F.col("quarters") - 1))
    pairs = pairs.select("cusip", "ticker", "quarters", between.alias("gap"))
    order = Window.partitionBy("cusip").orderBy("gap", "ticker")
    ranked = pairs.withColumn("k", F.row_number().over(order)).withColumn("runner_up_gap", F.lead("gap").over(order)).where("k = 1").drop("k")
    ok = (F.col("gap") <= gap) & (F.coalesce("runner_up_gap", F.lit(float("inf"))) > F.greatest(3 * F.col("gap"), F.lit(0.05)))
    return ranked.withColumn("accepted", ok)


def sleeve_weights(positions: DataFrame, statements: DataFrame) -> DataFrame:
    """Share of each asset class in an account's statements, by year."""
    by = positions.join(statements.select("statement_id", "period_end"), "statement_id").groupBy("account_id", F.year("period_end").alias("year"), "asset_class").agg(F.sum("market_value").alias("v"))
    return by.withColumn("w", F.col("v") / F.sum("v").over(Window.partitionBy("account_id", "year"))).drop("v")


def prior_positions(positions: DataFrame, statements: DataFrame) -> DataFrame:
    """The positions of the statement before, for each statement."""
    before = statements.select("statement_id", F.lag("statement_id").over(Window.partitionBy("account_id").orderBy("period_end")).alias("prior")).where("prior is not null")
    return before.join(positions.select(F.col("statement_id").alias("prior"), "identifier", "market_value"), "prior")


def allocation_effect(weights: DataFrame, policy: DataFrame, returns: DataFrame) -> DataFrame:
    """Brinson-Fachler allocation by sleeve and year: (w - policy) (sleeve return - policy return)."""
    pol = policy.join(returns, "asset_class").groupBy("year").agg(F.sum(F.col("policy_w") * F.col("r")).alias("policy_r"))
    rows = weights.join(policy, "asset_class").join(returns, ["asset_class", "year"]).join(pol, "year")
    return rows.groupBy("account_id", "year").agg(F.sum((F.col("w") - F.col("policy_w")) * (F.col("r") - F.col("policy_r"))).alias("allocation"), F.sum(F.col("w") * F.col("r")).alias("blend_r"), F.max("policy_r").alias("policy_r"))


def universe_robustness(panel: DataFrame, holders: DataFrame, signal: str, target: str, thresholds=(1, 2, 5)) -> DataFrame:
    """Mean information coefficient among names with at least so many holders. panel and holders share (month, ticker)."""
    rows = panel.join(holders, ["month", "ticker"]).where(F.col(signal).isNotNull() & F.col(target).isNotNull()).withColumn("least", F.explode(F.array(*[F.lit(t) for t in thresholds]))).where(F.col("holders") >= F.col("least"))
    ranked = rows.withColumn("a", average_rank(signal, "least", "month")).withColumn("b", average_rank(target, "least", "month"))
    ics = ranked.groupBy("least", "month").agg(F.count("*").alias("n"), F.corr("a", "b").alias("ic")).where("n >= 10")
    return ics.groupBy("least").agg(F.count("ic").alias("months"), F.avg("ic").alias("mean_ic"), F.avg("n").alias("names"))


def years_needed(ratios: DataFrame) -> DataFrame:
    """Years of record until an information ratio shows a t of two and three."""
    need = lambda t: F.when(F.col("ir") > 0, F.pow(F.lit(t) / F.col("ir"), F.lit(2)))
    return ratios.withColumn("years_t2", need(2.0)).withColumn("years_t3", need(3.0))


def tracking_error(active: DataFrame, cov: DataFrame) -> DataFrame:
    """Yearly tracking error of active(portfolio, slug, w) under monthly cov(a, b, v)."""
    x, z = active.select("portfolio", F.col("slug").alias("a"), F.col("w").alias("wa")), active.select("portfolio", F.col("slug").alias("b"), F.col("w").alias("wb"))
    q = x.join(cov, "a").join(z, ["portfolio", "b"]).groupBy("portfolio").agg(F.sum(F.col("wa") * F.col("wb") * F.col("v")).alias("q"))
    return q.select("portfolio", F.sqrt(12 * F.greatest("q", F.lit(0.0))).alias("tracking_error"))




def sleeve_returns(prices: DataFrame, sleeves: DataFrame, rf: DataFrame) -> DataFrame:
    """(sleeve, month, r): monthly returns of each sleeve's proxy, and of cash from rf(month, rf).

    prices(ticker, month, price) by month end; sleeves(sleeve, ticker) is a small list. A month has a return only if
    its price and that of the month before are there: gaps aren't bridged.
    """
    w = Window.partitionBy("ticker").orderBy("month")
    held = prices.join(sleeves.select("ticker").distinct(), "ticker", "left_semi")
    moved = held.withColumn("before", F.lag("price").over(w)).withColumn("then", F.lag("month").over(w))
    moved = moved.where(F.col("then") == F.last_day(F.add_months("month", -1))).select("ticker", "month", (F.col("price") / F.nullif("before", F.lit(0)) - 1).alias("r"))
    return sleeves.join(moved, "ticker").where("r is not null").select("sleeve", "month", "r").unionByName(rf.select(F.lit("cash").alias("sleeve"), "month", F.col("rf").alias("r")))


def home_weights(markets: DataFrame, key: str, window: int = 12) -> DataFrame:
    """(key, year, home, abroad): the home share of a world index, as known at the start of each year.

    markets(key, month, world, home, abroad) are returns; the share is the least-squares weight of
    world = w home + (1 - w) abroad over the last months that have all three, in 0 to 1. A year takes the latest share
    of a year before it; without so many months before, or where both parts moved alike throughout, it is null.
    """
    full = markets.dropna(subset=["world", "home", "abroad"]).withColumn("x", F.col("home") - F.col("abroad")).withColumn("y", F.col("world") - F.col("abroad"))
    w = Window.partitionBy(key).orderBy("month").rowsBetween(1 - window, 0)
    share = F.sum(F.col("x") * F.col("y")).over(w) / F.nullif(F.sum(F.col("x") * F.col("x")).over(w), F.lit(0.0))
    rolled = full.select(key, "month", F.when(F.count("*").over(w) == window, F.when(share < 0, 0.0).when(share > 1, 1.0).otherwise(share)).alias("w"))
    yearly = rolled.groupBy(key, F.year("month").alias("year")).agg(F.max_by("w", "month").alias("last"))
    known = F.lag("last").over(Window.partitionBy(key).orderBy("year"))
    return yearly.select(key, "year", known.alias("home"), (1 - known).alias("abroad"))


def curves(series: DataFrame, key: str, value: str) -> DataFrame:
    """(key, month, growth, total): what one unit grew to, and the running sum, of a return series by key.

    Months without a value carry both on; before the first value both are null. A loss of all or more ends the growth
    at zero.
    """
    w = Window.partitionBy(key).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    lost = F.max((F.col(value) <= -1).cast("int")).over(w) == 1
    grown = F.exp(F.sum(F.when(F.col(value) > -1, F.log1p(value))).over(w))
    return series.select(key, "month", F.when(lost, 0.0).otherwise(grown).alias("growth"), F.sum(value).over(w).alias("total"))


def merged_matches(prints: DataFrame, moves: DataFrame) -> DataFrame:
    """Every match by price path, and by holders where the paths are silent; corroborated says if holders agree.

    prints(cusip, ticker, accepted), moves(cusip, now, moved, holders): of several moves of a line that with most
    managers counts, then the least name. A line without a price match, accepted or not, is taken from the moves.
    """
    best = moves.groupBy("cusip").agg(F.min_by(F.struct("now", "moved", "holders"), F.struct(-F.col("moved"), "now")).alias("m")).select("cusip", "m.*")
    first = prints.select("cusip", "ticker", "accepted", F.lit("price path").alias("how")).join(best, "cusip", "left")
    second = best.join(prints.select("cusip"), "cusip", "left_anti").select("cusip", F.lit(None).cast(prints.schema["ticker"].dataType).alias("ticker"), F.lit(True).alias("accepted"), F.lit("holder migration").alias("how"), "now", "moved", "holders")
    return first.unionByName(second).withColumn("corroborated", F.coalesce(F.col("moved") > 0, F.lit(False)))


def error_census(books: DataFrame, shares: DataFrame, renames: DataFrame, lines: DataFrame, returns: DataFrame) -> DataFrame:
    """(issue, cases, both_sides): six classes of data error, counted in the data as it stands.

    books(slug, period, value) whose total moves a thousandfold from one filing to the next (both_sides: and back at the
    one after it, a typing error); tickers whose share counts were put on another split basis, and filed counts that were
    dropped, of shares(ticker, end, filed, value, form); lines found again under a new name, of renames(cusip, accepted);
    lines(cusip, ticker) without a ticker that weren't; returns(spike) that are no prices. Empty tables count nothing.
    """
    from .signals import usable_shares

    w = Window.partitionBy("slug").orderBy("period")
    total = books.groupBy("slug", "period").agg(F.sum("value").alias("v"))
    steps = total.select((F.col("v") / F.nullif(F.lag("v").over(w), F.lit(0.0))).alias("up"), (F.lead("v").over(w) / F.nullif(F.col("v"), F.lit(0.0))).alias("on"))
    jumped = lambda c: F.coalesce((F.col(c) > 0) & (F.round(F.log(c) / math.log(1000)) != 0), F.lit(False))
    row = lambda d, issue, cases, both=F.lit(None): d.agg(cases.cast("long").alias("cases"), both.cast("long").alias("both_sides")).select(F.lit(issue).alias("issue"), "cases", "both_sides")
    raw = shares.groupBy("ticker", "end").agg(F.max(F.struct("filed", "value")).alias("x")).select("ticker", "end", F.col("x.value").alias("raw"))
    both = raw.join(usable_shares(shares).select("ticker", "end", "value"), ["ticker", "end"], "left")
    found = renames.where("accepted").select("cusip").distinct()
    out = [
        row(steps, "unit of book values", F.count_if(jumped("up")), F.count_if(jumped("up") & jumped("on"))),
        row(both.where(F.round(F.col("value") / F.col("raw"), 3) != 1), "split basis of share counts", F.countDistinct("ticker")),
        row(both.where("value is null"), "dropped share counts", F.count("*")),
        row(found, "renamed lines", F.count("*")),
        row(lines.where("ticker is null").select("cusip").distinct().join(found, "cusip", "left_anti"), "lines without a price", F.count("*")),
        row(returns.where("spike"), "impossible returns", F.count("*")),
    ]
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every
