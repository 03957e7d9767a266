"""How well predicted risk was calibrated, and portfolios of a signal held through time against the aggregate book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .risk import average_rank
from .signals import cross_sections, drifted, spells

WINDOW, HALF_LIFE, SHRINK = 60, 24.0, 12.0


def seeded(ticker: str, month: str, draw: str, seed: int) -> Column:
    """Text that orders a month's names at random for each draw; it depends on their names alone."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(month).cast("string"), F.col(draw).cast("string"), F.col(ticker)))


def random_portfolios(names: DataFrame, portfolios: int = 100, size: int = 50, seed: int = 0) -> DataFrame:
    """(month, draw, ticker): so many draws of size names without replacement from each month of names(month, ticker).

    Months with fewer than twice as many names have none. The first of each draw's order are kept in the tasks already.
    """
    enough = names.groupBy("month").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * size).select("month")
    every = names.join(F.broadcast(enough), "month").select("month", "ticker", F.explode(F.sequence(F.lit(0), F.lit(portfolios - 1))).alias("draw"))  # a row for each month
    order = Window.partitionBy("month", "draw").orderBy(seeded("ticker", "month", "draw", seed), "ticker")
    return every.withColumn("k", F.row_number().over(order)).where(F.col("k") <= size).select("month", "draw", "ticker")


def exposures(panel: DataFrame, styles: list[str]) -> DataFrame:
    """(month, ticker, factor, x): the market, each style's score and the sector of panel(month, ticker, sector, styles)."""
    style = [F.struct(F.lit(s).alias("factor"), F.col(s).cast("double").alias("x")) for s in styles]
    rows = F.array(F.struct(F.lit("market").alias("factor"), F.lit(1.0).alias("x")), *style, F.struct(F.concat(F.lit("ind:"), "sector").alias("factor"), F.lit(1.0).alias("x")))
    return panel.select("month", "ticker", F.explode(rows).alias("e")).select("month", "ticker", "e.*")


def past_weights(months: DataFrame, window: int = WINDOW, half_life: float = HALF_LIFE, least: int = 24) -> DataFrame:
    """(asof, month, w): for each month, weights of the window months strictly before it; months with too few before have none."""
    k = F.row_number().over(Window.orderBy("month"))  # the rows are months
    placed = months.select("month").distinct().withColumn("k", k)
    back = placed.select(F.col("month").alias("asof"), F.col("k").alias("at"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("k") - window), F.col("k") - 1)).alias("k")).where(F.col("at") > least)
    return back.join(placed, "k").select("asof", "month", F.pow(F.lit(0.5), (F.col("at") - F.col("k") - 1) / half_life).alias("w"))


def predicted_risk(held: DataFrame, panel: DataFrame, styles: list[str], least: int = 24) -> DataFrame:
    """(month, draw, predicted, realized) of portfolios held(month, draw, ticker, w), all months in one job.

    The risk model is as it was known: factor returns of the 60 months before, by age, as the weighted variance of what
    the portfolio's exposures would have earned in each; and each name's specific variance, shrunk to the month's median by
    n / (n + 12), which also stands for names without a record. predicted is a month's volatility, realized the next
    month's return. A factor without a return in a month counts as 0 there. panel(month, ticker, sector, fwd, styles).
    """
    full = panel.select("month", "ticker", "sector", "fwd", *styles).dropna()
    earned = cross_sections(full, styles).where("ret is not null").select("month", "factor", "ret")
    load, ages = exposures(full, styles), past_weights(earned.select("month"), least=least)
    x = held.join(load, ["month", "ticker"]).groupBy("month", "draw", "factor").agg(F.sum(F.col("w") * F.col("x")).alias("x")).withColumnRenamed("month", "asof")
    past = earned.join(F.broadcast(ages), "month")  # window rows for each month
    path = x.join(past, ["asof", "factor"]).groupBy("asof", "draw", "month", "w").agg(F.sum(F.col("x") * F.col("ret")).alias("y"))
    mean = F.sum(F.col("w") * F.col("y")) / F.sum("w")
    common = path.groupBy("asof", "draw").agg((F.sum(F.col("w") * F.col("y") * F.col("y")) / F.sum("w") - mean * mean).alias("factor_var"))
    fit = load.join(earned, ["month", "factor"]).groupBy("month", "ticker").agg(F.sum(F.col("x") * F.col("ret")).alias("fit"))
    own = full.join(fit, ["month", "ticker"]).select("month", "ticker", (F.col("fwd") - F.col("fit")).alias("u"))
    seen = own.join(F.broadcast(ages), "month").groupBy("asof", "ticker").agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("u") * F.col("u")) / F.sum("w")).alias("v"))
    mid = seen.groupBy("asof").agg(F.percentile("v", F.lit(0.5)).alias("mid"))
    names = held.withColumnRenamed("month", "asof").join(F.broadcast(mid), "asof").join(seen, ["asof", "ticker"], "left")  # a row for each month
    shrunk = F.coalesce(F.col("n") / (F.col("n") + SHRINK) * F.col("v") + SHRINK / (F.col("n") + SHRINK) * F.col("mid"), F.col("mid"))
    specific = names.groupBy("asof", "draw").agg(F.sum(F.col("w") * F.col("w") * shrunk).alias("specific_var"))
    got = held.join(full.select("month", "ticker", "fwd"), ["month", "ticker"]).groupBy(F.col("month").alias("asof"), "draw").agg(F.sum(F.col("w") * F.col("fwd")).alias("realized"))
    both = common.join(specific, ["asof", "draw"]).join(got, ["asof", "draw"])
    return both.select(F.col("asof").alias("month"), "draw", F.sqrt(F.greatest(F.col("factor_var"), F.lit(0.0)) + F.col("specific_var")).alias("predicted"), "realized")


def bias_statistic(panel: DataFrame, styles: list[str], portfolios: int = 100, size: int = 50, seed: int = 0, least: int = 24) -> DataFrame:
    """(kind, year, n, bias): deviation of realised over predicted risk, about 1 where the model is calibrated.

    Of random portfolios of equal weights, and of each month's whole universe; year null is all years. Years with one
    portfolio have no bias, and tables too short for a prediction no rows.
    """
    full = panel.select("month", "ticker", "sector", "fwd", *styles).dropna()
    drawn = random_portfolios(full.select("month", "ticker"), portfolios, size, seed).withColumn("w", F.lit(1.0 / size))
    months = drawn.select("month").distinct()
    count = F.count("*").over(Window.partitionBy("month"))
    whole = full.select("month", "ticker").join(F.broadcast(months), "month").select("month", F.lit(-1).alias("draw"), "ticker", (1.0 / count).alias("w"))  # a row for each month
    z = predicted_risk(drawn.unionByName(whole), full, styles, least).where("predicted > 0").select(F.when(F.col("draw") < 0, "universe").otherwise("random").alias("kind"), F.year("month").alias("year"), (F.col("realized") / F.col("predicted")).alias("z"))
    both = z.unionByName(z.withColumn("year", F.lit(None).cast("int")))
    return both.groupBy("kind", "year").agg(F.count("*").alias("n"), F.stddev_samp("z").alias("bias"))


def aggregate_book(books: DataFrame, prices: DataFrame, least: int = 5) -> DataFrame:
    """The benchmark: (formation, ticker, w) of all managers' value in names that so many hold and that cost a dollar at formation."""
    held = books.where("ticker is not null").groupBy("formation", "ticker").agg(F.countDistinct("slug").alias("holders"), F.sum("value").alias("value")).where(F.col("holders") >= least)
    priced = held.join(prices.where("price >= 1").select("ticker", F.col("month").alias("formation")), ["formation", "ticker"], "left_semi")
    return priced.select("formation", "ticker", (F.col("value") / F.sum("value").over(Window.partitionBy("formation"))).alias("w"))


def signal_backtest(bench: DataFrame, signal: DataFrame, returns: DataFrame, months: DataFrame, cost: float = 0.001, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """The signal's best tenth of the aggregate book, equally weighed, held between formations; and the rebalance log.

    bench(formation, ticker, w), signal(month, ticker, s). The universe is the book's names with a signal; formations with
    fewer than least names are left out, and what was held goes on. A spell starts from its targets, so weights within it
    are a closed form, and the state carried over a formation is the old spell's last drifted weights: trades are what
    parts them from the targets, and twice the turnover times the cost is taken from the first month's return. The first
    formation buys all.

    Returns (month, portfolio, benchmark, names) and (formation, universe, names, turnover, drag, active_share,
    transfer, realized_ic): transfer is the correlation of active weight and signal over the universe, realized_ic the
    rank correlation of signal and return until the next formation.
    """
    live = bench.join(signal.where("s is not null").select(F.col("month").alias("formation"), "ticker", "s"), ["formation", "ticker"])
    own = Window.partitionBy("formation")
    sized = live.withColumn("n", F.count("*").over(own)).where(F.col("n") >= least).withColumn("b", F.col("w") / F.sum("w").over(own))
    k = F.row_number().over(own.orderBy(F.desc("s"), "ticker"))
    kept = sized.withColumn("kept", k <= F.greatest(F.lit(10), F.floor(F.col("n") / 10)))
    top = kept.where("kept").select("formation", "ticker", (1.0 / F.count("*").over(own)).alias("w"))
    both = top.select(F.lit("portfolio").alias("kind"), "formation", "ticker", "w").unionByName(sized.select(F.lit("benchmark").alias("kind"), "formation", "ticker", F.col("b").alias("w")))
    held = spells(both, months, "kind").select("kind", "formation", "month")
    grown = drifted(both, returns, held, "kind")
    by = grown.groupBy("kind", "formation", "month").agg(F.sum(F.col("weight") * F.col("r")).alias("r"), F.count("*").alias("names"))
    # what is left of each spell at its last month, against the next targets
    spell = Window.partitionBy("kind", "formation")
    last = grown.withColumn("end", F.max("month").over(spell)).where("month = end").withColumn("after", F.col("weight") * (1 + F.col("r")))
    follows = both.select("kind", "formation").distinct().withColumn("next", F.lead("formation").over(Window.partitionBy("kind").orderBy("formation")))
    after = last.withColumn("old", F.col("after") / F.sum("after").over(spell)).join(follows, ["kind", "formation"]).where("next is not null and kind = 'portfolio'")
    trades = top.select("formation", "ticker", F.col("w").alias("new")).join(after.select(F.col("next").alias("formation"), "ticker", "old"), ["formation", "ticker"], "full_outer")
    moved = trades.groupBy("formation").agg((F.sum(F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))) / 2).alias("half"), F.count("old").alias("n_old"), F.count("new").alias("names"))
    turned = moved.select("formation", "names", F.when(F.col("n_old") > 0, F.col("half")).otherwise(1.0).alias("turnover")).withColumn("drag", 2 * F.col("turnover") * cost)
    share = kept.join(top.select("formation", "ticker", F.col("w").alias("p")), ["formation", "ticker"], "left").groupBy("formation").agg(F.max("n").alias("universe"), (F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.col("b"))) / 2).alias("active_share"), F.corr(F.coalesce("p", F.lit(0.0)) - F.col("b"), "s").alias("transfer"))
    spans = held.where("kind = 'benchmark'").select("formation", "month")
    ahead = kept.select("formation", "ticker", "s").join(spans, "formation").join(returns.where("r is not null").select("ticker", "month", "r"), ["ticker", "month"]).groupBy("formation", "ticker", "s").agg((F.product(1 + F.col("r")) - 1).alias("f"))
    ranked = ahead.withColumn("rs", average_rank("s", "formation")).withColumn("rf", average_rank("f", "formation")).groupBy("formation").agg(F.when(F.count("*") >= least, F.corr("rs", "rf")).alias("realized_ic"))
    log = turned.join(share, "formation").join(ranked, "formation", "left").select("formation", "universe", "names", "turnover", "drag", "active_share", "transfer", "realized_ic")
    first = F.col("month") == F.min("month").over(Window.partitionBy("formation"))
    net = by.where("kind = 'portfolio'").join(turned.select("formation", "drag"), "formation").select("month", (F.col("r") - F.when(first, F.col("drag")).otherwise(0.0)).alias("portfolio"), "names")
    return net.join(by.where("kind = 'benchmark'").select("month", F.col("r").alias("benchmark")), "month", "full_outer").select("month", "portfolio", "benchmark", "names"), log


def fundamental_law(monthly: DataFrame, log: DataFrame, rebalances: int = 4) -> DataFrame:
    """One row: what the law of active management implies for a backtest, and what it delivered.

    From signal_backtest(): the mean realised rank correlation and its t, the mean transfer, bets a year (names times
    rebalances, counted as if independent), the ratio they imply, the delivered information ratio, its standard error and t.
    """
    ic = log.agg(F.avg("realized_ic").alias("ic"), F.try_divide(F.avg("realized_ic"), F.stddev_samp("realized_ic") / F.sqrt(F.count("realized_ic"))).alias("ic_t"), F.avg("transfer").alias("transfer"), (F.avg("universe") * rebalances).alias("breadth"))
    a = F.col("portfolio") - F.col("benchmark")
    real = monthly.where("portfolio is not null and benchmark is not null").agg((F.count("*") / 12).alias("years"), (F.try_divide(F.avg(a), F.stddev_samp(a)) * F.sqrt(F.lit(12.0))).alias("ir_actual"))
    both = ic.join(real, how="inner").withColumn("ir_implied", F.col("transfer") * F.col("ic") * F.sqrt("breadth"))  # one row each
    se = F.sqrt(F.try_divide(1 + F.col("ir_actual") * F.col("ir_actual") / 2, F.col("years")))
    return both.select("ic", "ic_t", "transfer", "breadth", "ir_implied", "ir_actual", "years", se.alias("ir_se"), (F.col("ir_actual") * F.sqrt("years")).alias("ir_t"))
