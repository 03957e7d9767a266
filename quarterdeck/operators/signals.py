"""Prices, portfolios formed from holdings, signal panels, the risk model and the checks of target weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dot, previous_month, robust_z, split_ratio


def clean_returns(prices: DataFrame) -> DataFrame:
    """(ticker, month, r, spike): change from the calendar month before; a jump above +300 % from under 5 is null and marked.

    A missing month gives no return: this is a join on the month, no lag.
    """
    before = prices.select("ticker", F.col("month").alias("m0"), F.col("price").alias("p0"))
    both = prices.withColumn("m0", previous_month(F.col("month"))).join(before, ["ticker", "m0"])
    r = F.col("price") / F.col("p0") - 1
    spike = (r > 3) & (F.col("p0") < 5)
    return both.select("ticker", "month", F.when(~spike, r).alias("r"), spike.alias("spike"))


def month_end_prices(daily: DataFrame, asof: str) -> DataFrame:
    """The last bar of each ticker and full month; prices that aren't positive are null."""
    last_full = F.date_sub(F.trunc(F.lit(asof).cast("date"), "month"), 1)
    rows = daily.withColumn("month", F.last_day("date")).where(F.col("month") <= last_full)
    return rows.groupBy("ticker", "month").agg(F.max_by("price", "date").alias("price")).withColumn("price", F.when(F.col("price") > 0, F.col("price")))


def with_fallback(closes: DataFrame, prices: DataFrame) -> DataFrame:
    """Closes, and total-return prices where there are none."""
    c = closes.select("ticker", "month", F.col("price").alias("close"))
    return prices.join(c, ["ticker", "month"], "left").select("ticker", "month", F.coalesce("close", "price").alias("close"))


def spells(formations: DataFrame, months: DataFrame, *key: str, stale: int | None = None) -> DataFrame:
    """Each month with the latest formation before it, at most stale months ago. Formations are few dates a key."""
    w = Window.partitionBy(*key).orderBy("formation")
    ends = formations.select(*key, "formation").distinct().withColumn("until", F.lead("formation").over(w))
    if stale:
        ends = ends.withColumn("until", F.least(F.coalesce("until", F.lit("9999-12-31").cast("date")), F.last_day(F.add_months("formation", stale))))
    on = (F.col("month") > F.col("formation")) & (F.col("until").isNull() | (F.col("month") <= F.col("until")))
    return ends.join(F.broadcast(months), on)  # a row for each month


def drifted(weights: DataFrame, returns: DataFrame, held: DataFrame, *key: str) -> DataFrame:
    """Weights at the start of each month of a holding spell, in closed form: w times what grew since, to one.

    A name falls out at its first missing return. weights(key, formation, ticker, w), held(key, formation, month).
    """
    grid = weights.join(held, [*key, "formation"]).join(returns.select("ticker", "month", "r"), ["ticker", "month"], "left")
    own = Window.partitionBy(*key, "formation", "ticker").orderBy("month")
    lost = F.max(F.col("r").isNull().cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    grown = F.coalesce(F.product(1 + F.col("r")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    live = grid.withColumn("lost", lost).withColumn("grown", F.col("w") * grown).where("lost = 0")
    return live.withColumn("weight", F.col("grown") / F.sum("grown").over(Window.partitionBy(*key, "month"))).drop("grown", "lost")


def portfolio_returns(weights: DataFrame, returns: DataFrame, months: DataFrame, *key: str, least: int = 5, stale: int | None = None) -> DataFrame:
    """Monthly return, names and turnover of buy-and-hold portfolios between formations."""
    held = spells(weights, months, *key, stale=stale).select(*key, "formation", "month")
    live = drifted(weights, returns, held, *key)
    return live.groupBy(*key, "month").agg(F.sum(F.col("weight") * F.col("r")).alias("r"), F.count("*").alias("names")).where(F.col("names") >= least)


def turnover(weights: DataFrame, returns: DataFrame, months: DataFrame, *key: str) -> DataFrame:
    """Half the change from the drifted old weights to the new target, at each formation."""
    live = drifted(weights, returns, spells(weights, months, *key).select(*key, "formation", "month"), *key)
    end = live.withColumn("after", F.col("weight") * (1 + F.col("r")))
    after = end.withColumn("share", F.col("after") / F.sum("after").over(Window.partitionBy(*key, "month"))).select(*key, F.col("month").alias("formation"), "ticker", F.col("share").alias("old"))
    new = weights.select(*key, "formation", "ticker", F.col("w").alias("new"))
    both = new.join(after, [*key, "formation", "ticker"], "full_outer").groupBy(*key, "formation").agg((F.sum(F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))) / 2).alias("turnover"), F.count("new").alias("n"), F.count("old").alias("n_old"))
    return both.where("n > 0 and n_old > 0").select(*key, "formation", "turnover")


def holding_paths(prices: DataFrame, returns: DataFrame, months: DataFrame, stale: int = 4) -> DataFrame:
    """For each (ticker, formation) with a price what a holding comes to in the k-th month after, k below stale.

    Columns m_k (the month), g_k (growth before it, null once a return was missing) and r_k (its return). That is the same
    for all managers, so there are a few rows for each ticker and month.
    """
    at = prices.select("ticker", F.col("month").alias("formation")).distinct()
    near = (F.col("month") > F.col("formation")) & (F.col("month") <= F.last_day(F.add_months("formation", stale)))
    ahead = at.select("formation").distinct().join(F.broadcast(months), near)  # a row for each month
    ahead = ahead.withColumn("k", F.row_number().over(Window.partitionBy("formation").orderBy("month")) - 1)
    grid = at.join(ahead, "formation").join(returns.select("ticker", "month", "r"), ["ticker", "month"], "left")
    before = Window.partitionBy("ticker", "formation").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    grown = F.coalesce(F.product(1 + F.coalesce("r", F.lit(0.0))).over(before), F.lit(1.0))
    grid = grid.withColumn("g", F.when(F.coalesce(F.max(F.col("r").isNull().cast("int")).over(before), F.lit(0)) == 0, grown))
    wide = grid.groupBy("ticker", "formation").agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{n}_{k}") for k in range(stale) for n, c in (("m", "month"), ("g", "g"), ("r", "r"))])
    return at.join(wide, ["ticker", "formation"], "left")


def clone_returns(books: DataFrame, paths: DataFrame, floor: float = 0.6, least: int = 5, stale: int = 4) -> DataFrame:
    """Each manager's book held from the end of its filing month to the next, at most four months; months below the
    coverage floor or with few names have no return. books(slug, period, filed, ticker, w), holding_paths() of as many months.

    A book's months are sums over its names, side by side: no row of a name and month is made, and books dealt by manager
    aren't dealt anew.
    """
    held = books.groupBy("slug", F.last_day("filed").alias("formation"), "ticker").agg(F.sum("w").alias("w")).join(paths, ["ticker", "formation"])
    g, r = (lambda k: F.col("w") * F.col(f"g_{k}")), (lambda k: F.col(f"r_{k}"))
    there = lambda k, c: F.when(r(k).isNotNull(), c)
    sums = held.groupBy("slug", "formation").agg(F.sum("w").alias("priced_share"), *[x for k in range(stale) for x in (
        F.max(f"m_{k}").alias(f"m_{k}"), F.sum(g(k)).alias(f"all_{k}"), F.sum(there(k, g(k) * r(k))).alias(f"wr_{k}"), F.sum(there(k, g(k))).alias(f"there_{k}"), F.count(there(k, g(k))).alias(f"names_{k}"))])
    sums = sums.withColumn("until", F.lead("formation").over(Window.partitionBy("slug").orderBy("formation")))
    each = F.explode(F.array(*[F.struct(*[F.col(f"{n}_{k}").alias(n) for n in ("m", "all", "wr", "there", "names")]) for k in range(stale)]))
    rows = sums.select("slug", "priced_share", "until", each.alias("x")).select("slug", "priced_share", "until", "x.*").where(F.col("all").isNotNull() & (F.col("until").isNull() | (F.col("m") <= F.col("until"))))
    by = rows.withColumn("coverage", F.col("there") / F.col("all") * F.col("priced_share"))
    return by.select("slug", F.col("m").alias("month"), F.when((F.col("coverage") >= floor) & (F.col("names") >= least), F.col("wr") / F.col("there")).alias("r"), "coverage", "names")


def contributions(live: DataFrame, market: DataFrame) -> DataFrame:
    """What each holding added, over the market's return too, with its share of the outperformance and its running sum."""
    rows = live.where("r is not null").join(F.broadcast(market.select("month", "rm")), "month")  # a row for each month
    by = rows.groupBy("slug", "ticker").agg(F.sum(F.col("weight") * F.col("r")).alias("contribution"), F.sum(F.col("weight") * (F.col("r") - F.col("rm"))).alias("active"), F.count("*").alias("months_held"), F.min("month").alias("first_held"), F.max("month").alias("last_held"))
    own = Window.partitionBy("slug")
    pos = F.sum(F.when(F.col("active") > 0, F.col("active"))).over(own)
    order = own.orderBy(F.desc("active"), "ticker")
    ranked = by.withColumn("rank", F.row_number().over(order)).withColumn("share", F.when(F.col("active") > 0, F.try_divide(F.col("active"), pos)))
    return ranked.withColumn("cum_share", F.when(F.col("active") > 0, F.sum(F.coalesce("share", F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0))))


def concentration(contributed: DataFrame) -> DataFrame:
    """Names that make half of the outperformance, and the share of the first five."""
    return contributed.where("share is not null").groupBy("slug").agg((F.count_if(F.col("cum_share") < 0.5) + 1).alias("names_to_half"), F.sum(F.when(F.col("rank") <= 5, F.col("share"))).alias("top5_share"))


def price_signals(returns: DataFrame, prices: DataFrame, months: DataFrame) -> DataFrame:
    """Momentum 12-1, reversal, volatility and next month's return on a dense spine of ticker and month."""
    spine = prices.select("ticker").distinct().crossJoin(F.broadcast(months.select("month")))  # a row for each month of each ticker
    dense = spine.join(prices, ["ticker", "month"], "left").join(returns.select("ticker", "month", "r"), ["ticker", "month"], "left")
    w = Window.partitionBy("ticker").orderBy("month")
    back = w.rowsBetween(-11, 0)
    return dense.select(
        "ticker", "month", "price", (F.lag("price", 1).over(w) / F.lag("price", 12).over(w) - 1).alias("momentum"), (1 - F.col("price") / F.lag("price", 1).over(w)).alias("reversal"),
        F.when(F.count("r").over(back) >= 2, -F.stddev_samp("r").over(back)).alias("low_vol"), F.lead("r").over(w).alias("fwd"),
    ).where("price is not null")


def z_scores(panel: DataFrame, signals: list[str]) -> DataFrame:
    """Each signal within its month, clipped."""
    own = Window.partitionBy("month")
    return panel.select(*[c for c in panel.columns if c not in signals], *[robust_z(F.col(s), own).alias(s) for s in signals])


def linear_composite(panel: DataFrame, signals: list[str]) -> DataFrame:
    """Mean of the signals there, if at least half are, scored again within the month."""
    there = F.filter(F.array(*signals), lambda x: x.isNotNull())
    mean = F.when(F.size(there) >= len(signals) / 2, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there))
    return panel.withColumn("raw", mean).withColumn("composite", robust_z(F.col("raw"), Window.partitionBy("month"))).drop("raw")


def signal_correlations(panel: DataFrame, signals: list[str]) -> DataFrame:
    """Mean over months of the rank correlation of each pair of signals."""
    from .risk import average_rank

    out = None
    for i, a in enumerate(signals):
        for b in signals[i + 1 :]:
            ok = panel.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("ra", average_rank(a, "month")).withColumn("rb", average_rank(b, "month"))
            one = ok.groupBy("month").agg(F.corr("ra", "rb").alias("c")).agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.avg("c").alias("corr"))
            out = one if out is None else out.unionByName(one)
    return out


def as_of(queries: DataFrame, facts: DataFrame, stale_days: int = 456) -> DataFrame:
    """For each (ticker, t) the value with the latest (filed, end) among those known at t whose period ended within the limit.

    A late filing for an old period hides nothing: stale periods are left out first. Of a day's facts only that of the
    latest period can be asked for. A fact counts in the months from its filing until its period is stale, some 16 at
    most, or until one of the next few filings is of no earlier period; so the join is by ticker and month and grows
    with the days of filing, not with the facts.
    """
    until = F.date_add("end", stale_days)
    f = facts.where("value is not null and filed is not null and end is not null").where(F.col("filed") <= until)
    f = f.groupBy("ticker", "filed").agg(F.max(F.struct("end", "value")).alias("x")).select("ticker", "filed", "x.*")
    later = [F.lead(F.struct("filed", "end"), k).over(Window.partitionBy("ticker").orderBy("filed")) for k in range(1, 7)]
    f = f.withColumns({f"later{k}": x for k, x in enumerate(later)})
    stop = F.least(until, *[F.when(F.col(f"later{k}.end") >= F.col("end"), F.date_sub(F.col(f"later{k}.filed"), 1)) for k in range(len(later))])
    held = f.select("ticker", "filed", "end", "value", F.explode(F.sequence(F.trunc("filed", "month"), F.trunc(stop, "month"), F.expr("interval 1 month"))).alias("month"))
    asked = queries.select("ticker", "t").distinct().withColumn("month", F.trunc("t", "month"))
    known = asked.join(held, ["ticker", "month"]).where((F.col("filed") <= F.col("t")) & (F.col("end") >= F.date_sub("t", stale_days)))
    last = known.groupBy("ticker", "t").agg(F.max(F.struct("filed", "end", "value")).alias("last"))
    return queries.select("ticker", "t").join(last, ["ticker", "t"], "left").select("ticker", "t", F.col("last.value").alias("value"), F.col("last.end").alias("end"))


def facts_of_kind(facts: DataFrame, kind: str) -> DataFrame:
    """Balance-sheet facts have no start; yearly flows span 330 to 400 days."""
    days = F.datediff("end", "start")
    return facts.where(F.col("start").isNull() if kind == "instant" else days.between(330, 400))


def clean_shares(filed: DataFrame) -> DataFrame:
    """Share counts without runs of at most three filings five times off their neighbours, on the last split basis.

    filed(ticker, end, value). Neighbours are the four filings before and after.
    """
    w = Window.partitionBy("ticker").orderBy("end")
    lv = F.log("value")
    near = F.concat(F.collect_list("lv").over(w.rowsBetween(-4, -1)), F.collect_list("lv").over(w.rowsBetween(1, 4)))
    x = filed.where("value > 0").withColumn("lv", lv).withColumn("near", F.array_sort(near))
    n = F.size("near")
    mid = (F.get("near", F.floor((n - 1) / 2).cast("int")) + F.get("near", F.floor(n / 2).cast("int"))) / 2
    x = x.withColumn("bad", (n >= 2) & (F.abs(F.col("lv") - mid) >= float(np.log(5)))).withColumn("flip", F.coalesce((F.col("bad") != F.lag("bad").over(w)).cast("int"), F.lit(1)))
    x = x.withColumn("run", F.sum("flip").over(w)).withColumn("length", F.count("*").over(Window.partitionBy("ticker", "run")))
    good = x.where(~(F.col("bad") & (F.col("length") <= 3))).select("ticker", "end", "value")
    jump = split_ratio(F.lead("value").over(w) / F.col("value"))
    later = Window.partitionBy("ticker").orderBy("end").rowsBetween(0, Window.unboundedFollowing)
    return good.withColumn("ratio", F.coalesce(jump, F.lit(1.0))).withColumn("value", F.col("value") * F.product("ratio").over(later)).drop("ratio")


#: Forms of filers whose share counts and prices are of one unit; others report ordinary shares beside a price per receipt.
DOMESTIC = ("10-K", "10-Q", "10-K/A", "10-Q/A")


def usable_shares(facts: DataFrame) -> DataFrame:
    """(ticker, end, filed, value): share counts of facts(ticker, end, filed, value, form) fit for market values.

    Domestic forms, the last filing for each period end, clean_shares(), and nothing 20 times off the series' median.
    """
    last = facts.where(F.col("form").isin(*DOMESTIC) & (F.col("value") > 0)).groupBy("ticker", "end").agg(F.max(F.struct("filed", "value")).alias("x")).select("ticker", "end", "x.*")
    kept = clean_shares(last.select("ticker", "end", "value")).withColumn("mid", F.percentile("value", F.lit(0.5)).over(Window.partitionBy("ticker")))
    kept = kept.where((F.col("value") <= 20 * F.col("mid")) & (F.col("value") >= F.col("mid") / 20)).drop("mid")
    return kept.join(last.select("ticker", "end", "filed"), ["ticker", "end"])


def facts_as_of(queries: DataFrame, facts: DataFrame, kinds: list[str], stale_days: int = 456) -> DataFrame:
    """J14 for several facts in one join: queries(ticker, t) with a column for each kind of facts(ticker, fact, filed, end, value)."""
    until = F.date_add("end", stale_days)
    f = facts.where(F.col("fact").isin(*kinds) & F.col("value").isNotNull() & F.col("filed").isNotNull() & F.col("end").isNotNull()).where(F.col("filed") <= until)
    held = f.select("ticker", "fact", "filed", "end", "value", F.explode(F.sequence(F.trunc("filed", "month"), F.trunc(until, "month"), F.expr("interval 1 month"))).alias("month"))
    asked = queries.select("ticker", "t").distinct().withColumn("month", F.trunc("t", "month"))
    known = asked.join(held, ["ticker", "month"]).where((F.col("filed") <= F.col("t")) & (F.col("end") >= F.date_sub("t", stale_days)))
    last = known.groupBy("ticker", "t").agg(*[F.max(F.when(F.col("fact") == k, F.struct("filed", "end", "value"))).alias(k) for k in kinds])
    return queries.join(last, ["ticker", "t"], "left").select(*queries.columns, *[F.col(f"{k}.value").alias(k) for k in kinds])


FUNDAMENTAL = ["size", "value", "profitability", "cash_flow", "earnings_yield"]


def fundamental_signals(closes: DataFrame, facts: DataFrame) -> DataFrame:
    """closes(ticker, month, close) with size, value, profitability, cash flow and earnings yield, as filed by then.

    facts(ticker, fact, start, end, filed, value, form): equity, assets and shares of a day, net income and operating cash
    flow of a year. The market value is of cleaned share counts; a signal without a positive base is null.
    """
    flows = ["net_income", "op_cf"]
    plain = facts_of_kind(facts.where(F.col("fact").isin("equity", "assets")), "instant").unionByName(facts_of_kind(facts.where(F.col("fact").isin(*flows)), "annual")).select("ticker", "fact", "filed", "end", "value")
    shares = usable_shares(facts_of_kind(facts.where("fact = 'shares'"), "instant")).select("ticker", F.lit("shares").alias("fact"), "filed", "end", "value")
    x = facts_as_of(closes.withColumnRenamed("month", "t"), plain.unionByName(shares), ["equity", "assets", "shares", *flows]).withColumn("cap", F.col("shares") * F.col("close"))
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return x.select(
        "ticker", F.col("t").alias("month"), F.when(F.col("cap") > 0, -F.log("cap")).alias("size"), F.when(F.col("equity") > 0, over("equity", "cap")).alias("value"),
        over("net_income", "assets").alias("profitability"), over("op_cf", "assets").alias("cash_flow"), over("net_income", "cap").alias("earnings_yield"),
    )


# ---- risk model


def cross_sections(panel: DataFrame, styles: list[str]) -> DataFrame:
    """Each month's returns on the market, styles and industries whose effects, weighed by names, sum to nothing.

    One month's names are a group. Rows: (month, factor, ret, r2).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        inds = sorted(pdf["sector"].unique())
        dummies = np.column_stack([(pdf["sector"] == s).to_numpy(float) for s in inds])
        share = dummies.mean(axis=0)
        free = dummies[:, :-1] - np.outer(dummies[:, -1], share[:-1] / share[-1])
        x = np.column_stack([np.ones(len(pdf)), pdf[styles].to_numpy(float), free])
        y = pdf["fwd"].to_numpy(float)
        b, *_ = np.linalg.lstsq(x, y, rcond=None)
        k = 1 + len(styles)
        last = -float(b[k:] @ share[:-1] / share[-1])
        tss = float(((y - y.mean()) ** 2).sum())
        r2 = 1 - float(((y - x @ b) ** 2).sum()) / tss if tss > 0 else None
        names = ["market", *styles, *[f"ind:{s}" for s in inds]]
        return pd.DataFrame({"month": pdf["month"].iloc[0], "factor": names, "ret": [*b.tolist(), last], "r2": r2})

    own = Window.partitionBy("month")
    full = panel.select("month", "sector", "fwd", *styles).dropna()
    enough = full.withColumn("n", F.count("*").over(own)).withColumn("k", F.size(F.collect_set("sector").over(own))).where(F.col("n") >= F.col("k") + len(styles) + 2)
    return enough.groupBy("month").applyInPandas(run, "month date, factor string, ret double, r2 double")


def ewma_weights(dates: DataFrame, window: int = 60, half_life: float = 24) -> DataFrame:
    """Weights of the last months by age; the rows are dates."""
    age = F.row_number().over(Window.orderBy(F.desc("month"))) - 1
    w = dates.select("month", age.alias("age")).where(F.col("age") < window).withColumn("w", F.pow(F.lit(0.5), F.col("age") / half_life))
    return w.select("month", (F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1)))).alias("w"))


def factor_covariance(series: DataFrame, asof: str, window: int = 60, half_life: float = 24) -> DataFrame:
    """Weighted covariance (i, j, v) of the factor returns strictly before a date."""
    past = series.where(F.col("month") < F.lit(asof).cast("date"))
    w = ewma_weights(past.select("month").distinct(), window, half_life)
    rows = past.join(F.broadcast(w), "month")  # window rows
    mean = rows.groupBy("factor").agg((F.sum(F.col("w") * F.col("ret")) / F.sum("w")).alias("m"))
    dev = rows.join(mean, "factor").select("month", "w", "factor", (F.col("ret") - F.col("m")).alias("d"))
    a, b = dev.select("month", "w", F.col("factor").alias("i"), F.col("d").alias("x")), dev.select("month", F.col("factor").alias("j"), F.col("d").alias("z"))
    return a.join(b, "month").groupBy("i", "j").agg((F.sum(F.col("w") * F.col("x") * F.col("z")) / F.sum("w")).alias("v"))


def specific_variance(resid: DataFrame, asof: str, shrink: float = 12) -> DataFrame:
    """Weighted variance of each name's residuals, pulled to the cross-section's median by n / (n + 12)."""
    past = resid.where(F.col("month") < F.lit(asof).cast("date"))
    rows = past.join(F.broadcast(ewma_weights(past.select("month").distinct())), "month")  # window rows
    own = rows.groupBy("ticker").agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("u") * F.col("u")) / F.sum("w")).alias("v"))
    mid = own.agg(F.percentile("v", F.lit(0.5)).alias("mid"))
    return own.crossJoin(F.broadcast(mid)).select("ticker", "n", (F.col("n") / (F.col("n") + shrink) * F.col("v") + shrink / (F.col("n") + shrink) * F.col("mid")).alias("v"))  # one row


def decompose(weights: DataFrame, exposures: DataFrame, cov: DataFrame, specific: DataFrame) -> DataFrame:
    """Yearly risk of each portfolio, split: exposures are sums, the quadratic form two joins; any number at once."""
    x = weights.join(exposures, "ticker").groupBy("portfolio", "factor").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    i, j = x.select("portfolio", F.col("factor").alias("i"), F.col("x").alias("xi")), x.select("portfolio", F.col("factor").alias("j"), F.col("x").alias("xj"))
    common = i.join(cov, "i").join(j, ["portfolio", "j"]).groupBy("portfolio").agg(F.sum(F.col("xi") * F.col("xj") * F.col("v")).alias("factor_var"))
    own = weights.join(specific, "ticker").groupBy("portfolio").agg(F.sum(F.col("w") * F.col("w") * F.col("v")).alias("specific_var"))
    both = common.join(own, "portfolio")
    y = lambda v: F.sqrt(12 * v)
    return both.select("portfolio", y(F.col("factor_var")).alias("factor_risk"), y(F.col("specific_var")).alias("specific_risk"), y(F.col("factor_var") + F.col("specific_var")).alias("total_risk"))


# ---- construction


def top_decile(scored: DataFrame, score: str) -> DataFrame:
    """Equal weights of each month's best tenth, ten names at least."""
    own = Window.partitionBy("month")
    ok = scored.where(F.col(score).isNotNull()).withColumn("n", F.count("*").over(own)).withColumn("k", F.row_number().over(own.orderBy(F.desc(score), "ticker")))
    kept = ok.where(F.col("k") <= F.greatest(F.lit(10), F.floor(F.col("n") / 10)))
    return kept.withColumn("w", 1.0 / F.count("*").over(own)).select("month", "ticker", "w")


def audit_weights(target: DataFrame, bench: DataFrame, sectors: DataFrame, cap: float = 0.05, band: float = 0.03, sector_band: float = 0.10) -> DataFrame:
    """For each formation of target(formation, ticker, w): sum, names above the cap and off the band, sectors off theirs, active share, names out of the universe."""
    both = target.select("formation", "ticker", "w").join(bench.select("formation", "ticker", F.col("w").alias("b")), ["formation", "ticker"], "full_outer")
    rows = both.withColumns({"active": F.coalesce("w", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))})
    by = rows.groupBy("formation").agg(F.sum("w").alias("total"), F.count_if(F.col("w") > cap).alias("over_cap"), F.count_if(F.abs("active") > band).alias("off_band"), (F.sum(F.abs("active")) / 2).alias("active_share"), F.count_if(F.col("b").isNull() & (F.col("w") > 0)).alias("outside"))
    sec = rows.join(sectors, "ticker", "left").groupBy("formation", "sector").agg(F.sum("active").alias("a")).groupBy("formation").agg(F.count_if(F.abs("a") > sector_band).alias("sectors_off"), F.max(F.abs("a")).alias("largest_sector"))
    return by.join(sec, "formation")


def trade_list(target: DataFrame, held: DataFrame, prices: DataFrame, nav: float, cost: float = 0.001) -> DataFrame:
    """Dollars, shares, side and cost that move held to target, both (ticker, w)."""
    both = target.select("ticker", F.col("w").alias("new")).join(held.select("ticker", F.col("w").alias("old")), "ticker", "full_outer").join(prices.select("ticker", "price"), "ticker", "left")
    change = F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))
    rows = both.withColumn("dollars", change * nav).where("dollars <> 0")
    return rows.select("ticker", "dollars", F.try_divide("dollars", "price").alias("shares"), F.when(F.col("dollars") > 0, "buy").otherwise("sell").alias("side"), (F.abs("dollars") * cost).alias("cost"))


def sector_exposure(target: DataFrame, bench: DataFrame, sectors: DataFrame) -> DataFrame:
    """Portfolio, benchmark and active weight by formation and sector."""
    s = lambda d, n: d.join(sectors, "ticker").groupBy("formation", "sector").agg(F.sum("w").alias(n))
    both = s(target, "portfolio").join(s(bench, "benchmark"), ["formation", "sector"], "full_outer").fillna(0.0, ["portfolio", "benchmark"])
    return both.withColumn("active", F.col("portfolio") - F.col("benchmark"))


def backtest_summary(returns: DataFrame, bench: DataFrame, *key: str) -> DataFrame:
    """Active return, tracking error, information ratio and hit rate of monthly returns(key, month, r)."""
    j = returns.join(F.broadcast(bench.select("month", F.col("r").alias("rb"))), "month").withColumn("a", F.col("r") - F.col("rb"))  # a row for each month
    return j.groupBy(*key).agg(F.count("*").alias("months"), (12 * F.avg("a")).alias("active"), (F.stddev_samp("a") * float(np.sqrt(12))).alias("tracking_error"), (F.try_divide(F.avg("a"), F.stddev_samp("a")) * float(np.sqrt(12))).alias("information_ratio"), F.avg((F.col("a") > 0).cast("double")).alias("hit_rate"))


def cost_sensitivity(gross: DataFrame, turned: DataFrame, rates: list[float], *key: str) -> DataFrame:
    """Yearly return less costs at each rate; the weights are given."""
    grid = F.explode(F.array(*[F.lit(x) for x in rates])).alias("rate")
    cost = turned.groupBy(*key).agg(F.avg("turnover").alias("turnover"), F.count("*").alias("formations"))
    mean = gross.groupBy(*key).agg((12 * F.avg("r")).alias("gross"))
    return mean.join(cost, list(key)).select(*key, "gross", "turnover", grid).withColumn("net", F.col("gross") - 4 * 2 * F.col("turnover") * F.col("rate"))


def capacity(weights: DataFrame, daily_volume: DataFrame, sizes: list[float], sd: float = 0.02) -> DataFrame:
    """Mean cost of trading each weight once at several portfolio sizes, by the square root of its share of a day's volume."""
    from ..functions.columns import market_impact

    rows = weights.join(daily_volume, "ticker").withColumn("size", F.explode(F.array(*[F.lit(float(s)) for s in sizes])))
    cost = market_impact(F.col("w") * F.col("size") / F.col("volume"), F.lit(sd))
    return rows.groupBy("size").agg((F.sum(F.col("w") * cost) / F.sum("w")).alias("cost"), F.percentile(F.col("w") * F.col("size") / F.col("volume"), F.lit(0.5)).alias("median_share"))


def trailing_features(panel: DataFrame) -> DataFrame:
    """Trailing excess and volatility over twelve months, deepest fall, and the next year's excess; null unless full."""
    w = Window.partitionBy("slug").orderBy("month")
    back, ahead = w.rowsBetween(-11, 0), w.rowsBetween(1, 12)
    full = lambda over, x: F.when(F.count("*").over(over) == 12, x)
    g = lambda c, over: F.product(1 + F.col(c)).over(over)
    folded = F.aggregate(F.collect_list("r_p").over(back), F.struct(F.lit(1.0).alias("i"), F.lit(1.0).alias("p"), F.lit(0.0).alias("d")),
                         lambda s, r: F.struct((s["i"] * (1 + r)).alias("i"), F.greatest(s["p"], s["i"] * (1 + r)).alias("p"), F.least(s["d"], s["i"] * (1 + r) / F.greatest(s["p"], s["i"] * (1 + r)) - 1).alias("d")))["d"]
    return panel.select(
        "slug", "month", full(back, g("r_p", back) - g("r_b", back)).alias("excess12"), full(back, F.stddev_samp("r_p").over(back)).alias("vol12"), full(back, folded).alias("drawdown12"),
        full(ahead, g("r_p", ahead) - g("r_b", ahead)).alias("fwd_excess"),
    )


def extremes(panel: DataFrame, score: str, target: str, k: int) -> DataFrame:
    """Mean target of the k highest and lowest scores of each month."""
    own = Window.partitionBy("month")
    rows = panel.where(F.col(score).isNotNull() & F.col(target).isNotNull()).withColumn("hi", F.row_number().over(own.orderBy(F.desc(score), "slug"))).withColumn("lo", F.row_number().over(own.orderBy(score, "slug")))
    return rows.groupBy("month").agg(F.avg(F.when(F.col("hi") <= k, F.col(target))).alias("high"), F.avg(F.when(F.col("lo") <= k, F.col(target))).alias("low"))


def blend(weights: Column, values: Column) -> Column:
    return dot(weights, values)
