"""Composites of accounts: which periods count, their aggregate return, dispersion, variants, fees and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_FOR_DISPERSION = 6


def cell(start: Column, end: Column, grid: str = "A") -> Column:
    """The whole year or month that a period is, else null."""
    if grid == "A":
        whole = (F.month(start) == 1) & (F.dayofmonth(start) == 1) & (F.month(end) == 12) & (F.dayofmonth(end) == 31) & (F.year(start) == F.year(end))
        return F.when(whole, F.year(end))
    return F.when((F.dayofmonth(start) == 1) & (end == F.last_day(start)), end)


def classify(periods: DataFrame, accounts: DataFrame, grid: str = "A", strategy: str | None = None, include_flagged: bool = False, include_non_discretionary: bool = False) -> DataFrame:
    """Cell, eligible, and the first reason against a period."""
    meta = accounts.select("account_id", "owner_type", "discretionary", "strategy", F.lit(True).alias("known"))
    joined = periods.join(meta, "account_id", "left").withColumn("cell", cell(F.col("period_start"), F.col("period_end"), grid))
    reason = F.when(F.col("known").isNull(), "not_in_accounts_csv")
    if not include_non_discretionary:
        reason = reason.when(F.upper(F.coalesce("discretionary", F.lit(""))) != "Y", "non_discretionary")
    if strategy:
        reason = reason.when(F.coalesce("strategy", F.lit("")) != strategy, "other_strategy")
    reason = reason.when(F.col("r").isNull(), "no_return").when(~F.col("full_period"), "partial_period").when(F.col("cell").isNull(), "not_grid_aligned")
    if not include_flagged:
        reason = reason.when(F.col("evidence") == "flagged", "flagged")
    return joined.withColumn("exclusion_reason", reason.otherwise("")).withColumn("eligible", F.col("exclusion_reason") == "").withColumn("owner_type", F.coalesce("owner_type", F.lit("client"))).drop("known")


def survivors(statements: DataFrame) -> DataFrame:
    """Accounts whose last statement ends on the last day of all, above nothing."""
    last = statements.groupBy("account_id").agg(F.max_by(F.struct("period_end", "ending_value"), F.struct("period_end", "statement_id")).alias("x"))
    final = statements.agg(F.max("period_end").alias("final"))
    return last.join(F.broadcast(final), F.col("x.period_end") == F.col("final")).where("x.ending_value > 0").select("account_id")


def aggregate_return(on: Column) -> Column:
    """The pooled return of the periods that on picks, as if they were one account."""
    s = lambda c: F.sum(F.when(on, F.col(c)))
    base = s("begin") + s("weighted_flows")
    return F.when(base > 0, (s("end") - s("begin") - s("net_flows")) / base)


def build(classified: DataFrame, alive: DataFrame) -> DataFrame:
    """A row for each cell, without fees."""
    marked = classified.join(alive.withColumn("survivor", F.lit(True)), "account_id", "left").withColumn("survivor", F.coalesce("survivor", F.lit(False)))
    mine = marked.where("eligible")
    asset = F.try_divide(F.sum(F.col("begin") * F.col("r")), F.sum("begin"))
    every, surv, principal = F.lit(True), F.col("survivor"), F.col("owner_type") == "principal"
    rows = mine.groupBy("cell").agg(
        F.count("*").alias("n"), F.sum("begin").alias("begin_assets"), F.sum("end").alias("end_assets"), F.sum("net_flows").alias("net_flows"), aggregate_return(every).alias("gross"),
        asset.alias("asset_weighted"), F.avg("r").alias("equal_weighted"), F.max("r").alias("high"), F.min("r").alias("low"), F.count_if(surv).alias("n_survivors"), aggregate_return(surv).alias("survivors_only"),
        F.count_if(~principal).alias("n_clients"), aggregate_return(~principal).alias("clients_only"), F.count_if(principal).alias("n_principal"), aggregate_return(principal).alias("principal_only"),
        F.count_if(F.col("evidence") == "verified").alias("n_verified"), F.count_if(F.col("evidence") == "unverified").alias("n_unverified"),
    )
    out = marked.where("cell is not null").groupBy("cell").agg(
        F.count_if(F.col("exclusion_reason") == "flagged").alias("n_excluded_flagged"), F.count_if(F.col("exclusion_reason") == "partial_period").alias("n_excluded_partial"),
        F.count_if(F.col("exclusion_reason").isin("non_discretionary", "other_strategy", "no_return", "not_grid_aligned")).alias("n_excluded_other"),
    )
    # two passes over the cell's periods, for the accuracy of the deviation
    wide = mine.join(rows.select("cell", "asset_weighted", "n"), "cell").groupBy("cell").agg(
        F.when(F.max("n") >= LEAST_FOR_DISPERSION, F.sqrt(F.sum(F.col("begin") * F.pow(F.col("r") - F.col("asset_weighted"), F.lit(2))) / F.sum("begin"))).alias("dispersion_sd")
    )
    enough = lambda c: F.when(F.col("n") >= LEAST_FOR_DISPERSION, F.col(c)).alias(c)
    joined = rows.join(out, "cell", "left").join(wide, "cell")
    return joined.select(*[enough(c) if c in ("high", "low") else F.col(c) for c in joined.columns])


def model_net(returns: DataFrame, order: str, *key: str, gross: str = "gross", years: str = "years", mgmt: float = 0.005, perf: float = 0.20, hurdle: float = 0.0) -> DataFrame:
    """(key, order, model_net): returns after a yearly fee and a share of gains above the high-water mark.

    The path is a fold over each key's returns in order, within one expression; a null return is skipped.
    """
    by = returns.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(gross).alias("r"), F.col(years).alias("y")))).alias("rs"))

    def step(acc, x):
        before = acc["nav"] * (1 + x["r"]) * (1 - mgmt * x["y"])
        bar = acc["hwm"] * F.pow(F.lit(1 + hurdle), x["y"])
        nav = F.when(before > bar, before - perf * (before - bar)).otherwise(before)
        return F.when(x["r"].isNull(), F.struct(acc["nav"].alias("nav"), acc["hwm"].alias("hwm"), F.concat(acc["out"], F.array(F.lit(None).cast("double"))).alias("out"))).otherwise(
            F.struct(nav.alias("nav"), F.greatest(acc["hwm"], nav).alias("hwm"), F.concat(acc["out"], F.array(nav / acc["nav"] - 1)).alias("out"))
        )

    path = F.aggregate("rs", F.struct(F.lit(1.0).alias("nav"), F.lit(1.0).alias("hwm"), F.array().cast("array<double>").alias("out")), step)
    zipped = F.explode(F.arrays_zip(F.col("rs.o").alias("o"), path["out"].alias("net")))
    return by.select(*key, zipped.alias("z")).select(*key, F.col("z.o").alias(order), F.col("z.net").alias("model_net"))


def longest_run(series: DataFrame, index: str, value: str, *key: str) -> DataFrame:
    """Rows of each key's longest run of adjacent indices with a value; of equal runs the earliest."""
    held = series.where(F.col(value).isNotNull())
    w = Window.partitionBy(*key).orderBy(index)
    runs = held.withColumn("run", F.col(index) - F.row_number().over(w))
    sizes = runs.groupBy(*key, "run").agg(F.count("*").alias("n"))
    best = sizes.groupBy(*key).agg(F.max_by("run", F.struct("n", -F.col("run"))).alias("run"))
    return runs.join(best, [*key, "run"], "left_semi").drop("run")


def series_summary(series: DataFrame, value: str, per_year: int, *key: str) -> DataFrame:
    """Statistics of each key's series."""
    years = F.count(value) / F.lit(float(per_year))
    total = F.product(1 + F.col(value))
    return series.groupBy(*key).agg(
        F.count(value).alias("n"), (total - 1).alias("cumulative"), F.when(total > 0, F.pow(total, 1 / years) - 1).alias("annualized"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"), F.min(value).alias("worst"), F.max(value).alias("best"),
    )


def full_year_mean(monthly: DataFrame, value: str, *key: str) -> DataFrame:
    """Mean of compounded years of twelve months."""
    years = monthly.groupBy(*key, F.year("month").alias("year")).agg(F.count(value).alias("n"), (F.product(1 + F.col(value)) - 1).alias("r")).where("n = 12")
    return years.groupBy(*key).agg(F.count("*").alias("years"), F.avg("r").alias("mean_year"))


def trailing(cells: DataFrame, value: str, horizons: list[int]) -> DataFrame:
    """Compounded return and share of verified periods over the last 1, 2, ... cells. A row for each cell is ranked."""
    last = cells.withColumn("k", F.row_number().over(Window.orderBy(F.desc("cell"))))
    wide = last.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons]))).where(F.col("k") <= F.col("h"))
    return wide.groupBy("h").agg(F.count("*").alias("n"), (F.product(1 + F.col(value)) - 1).alias("total"), (F.sum("n_verified") / F.sum("n")).alias("verified_share")).where("n = h")


def variant_gaps(cells: DataFrame) -> DataFrame:
    """Survivors, clients and principal against the whole, by cell."""
    g = lambda c: (F.col(c) - F.col("gross")).alias(f"{c}_gap")
    return cells.select("cell", g("survivors_only"), g("clients_only"), g("principal_only"), (F.col("principal_only") - F.col("clients_only")).alias("principal_less_clients"))
