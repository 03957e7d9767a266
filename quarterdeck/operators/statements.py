"""Account statements: checks of the tables, reconciliation of every statement, period returns, segments, money-weighted returns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import days_inclusive, matches

#: The kinds of flow and of asset that a table may name.
FLOW_TYPES = ("deposit", "withdrawal", "transfer_in", "transfer_out")
ASSET_CLASSES = ("us_equity", "intl_equity", "fund", "cash", "bond", "other")
ERRORS = (
    "UNUSABLE_ROW", "NEGATIVE_VALUE", "DUPLICATE_PERIOD", "PERIOD_OVERLAP", "CHAIN_BREAK", "FLOWS_MISMATCH", "POSITIONS_SUM_MISMATCH", "PNL_MISMATCH", "IMPLAUSIBLE_RETURN", "ORPHAN_FLOW",
)
LEAST_RETURN, MOST_RETURN, RETURN_POINTS = -0.70, 1.50, 1.0


# ---- checks of tables: each gives the rows at fault


def check_required(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each required value that is missing."""
    lacks = F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])))
    return df.withColumn("missing", lacks)


def check_unique(df: DataFrame, *key: str) -> DataFrame:
    """Keys that stand more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def check_period_order(statements: DataFrame) -> DataFrame:
    """P03."""
    return statements.where("period_end < period_start")


def check_domain(df: DataFrame, column: str, allowed) -> DataFrame:
    """Values outside the list; null is no value."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def check_flow_sign(flows: DataFrame) -> DataFrame:
    """Flows whose sign contradicts their kind, from the account's side."""
    inward = F.col("flow_type").isin("deposit", "transfer_in")
    outward = F.col("flow_type").isin("withdrawal", "transfer_out")
    return flows.where((inward & (F.col("amount") < 0)) | (outward & (F.col("amount") > 0)))


# ---- joins of statements with flows and positions


def flows_in_periods(statements: DataFrame, flows: DataFrame) -> DataFrame:
    """Every flow with the statement period that holds it; the account is the join key, the dates its filter."""
    f = flows.where("account_id is not null and date is not null and amount is not null").select(F.col("account_id").alias("f_account"), "date", "amount")
    return statements.join(f, (F.col("account_id") == F.col("f_account")) & F.col("date").between(F.col("period_start"), F.col("period_end"))).drop("f_account")


def orphan_flows(statements: DataFrame, flows: DataFrame) -> DataFrame:
    """Flows in no statement period of their account."""
    s = statements.where("period_start is not null and period_end is not null and ending_value is not null").select(F.col("account_id").alias("s_account"), "period_start", "period_end")
    return flows.join(s, (F.col("account_id") == F.col("s_account")) & F.col("date").between(F.col("period_start"), F.col("period_end")), "left_anti")


def orphan_positions(positions: DataFrame, statements: DataFrame) -> DataFrame:
    """J03."""
    return positions.join(statements.select("statement_id"), "statement_id", "left_anti")


def silent_accounts(accounts: DataFrame, statements: DataFrame) -> DataFrame:
    """Accounts without a statement."""
    return accounts.join(statements.select("account_id"), "account_id", "left_anti")


def position_sums(positions: DataFrame) -> DataFrame:
    """Sum, number and dates of a statement's positions, before they are joined."""
    held = positions.where("statement_id is not null and market_value is not null")
    return held.groupBy("statement_id").agg(F.sum("market_value").alias("positions_sum"), F.count("*").alias("n_positions"), F.min("as_of_date").alias("first_date"), F.max("as_of_date").alias("last_date"))


def previous(statements: DataFrame) -> DataFrame:
    """The statement before in the account, by period end, usable rows only."""
    w = Window.partitionBy("account_id").orderBy("period_end", "statement_id")
    ok = statements.where("period_start is not null and period_end is not null and ending_value is not null")
    return ok.withColumn("prev_end", F.lag("period_end").over(w)).withColumn("prev_value", F.lag("ending_value").over(w)).withColumn("prev_id", F.lag("statement_id").over(w))


def gaps(statements: DataFrame) -> DataFrame:
    """Missing days between a statement and the one before."""
    days = F.datediff("period_start", "prev_end") - 1
    return previous(statements).where("prev_end is not null").withColumn("gap_days", days).where("gap_days > 0").select("account_id", "statement_id", "prev_id", "gap_days")


def modified_dietz(begin: Column, end: Column, net: Column, weighted: Column) -> Column:
    """Gain over beginning value and weighted flows; null where that is not positive."""
    return F.when(begin + weighted > 0, (end - begin - net) / (begin + weighted))


def flow_weight(date: Column, start: Column, end: Column) -> Column:
    """Share of the period that a flow, booked at day's end, was there."""
    return F.datediff(end, date) / days_inclusive(start, end)


def reconcile(statements: DataFrame, flows: DataFrame, positions: DataFrame) -> DataFrame:
    """Every statement with what was computed, checks possible, passed and failed, its flags, and its status.

    flags is an array of codes in order; see orphan_flows() for the one that has no statement.
    """
    f = flows_in_periods(statements, flows).withColumn("w", flow_weight(F.col("date"), F.col("period_start"), F.col("period_end")))
    sums = f.groupBy("statement_id").agg(
        F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0.0)).alias("deposits"), F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(0.0)).alias("withdrawals"),
        F.sum(F.col("w") * F.col("amount")).alias("weighted"), F.count("*").alias("n_flows"),
    )
    bad = statements.where("period_start is null or period_end is null or ending_value is null").withColumn("prev_end", F.lit(None).cast("date")).withColumn("prev_value", F.lit(None).cast("double")).withColumn("prev_id", F.lit(None).cast("string"))
    rows = previous(statements).unionByName(bad).join(sums, "statement_id", "left").join(position_sums(positions), "statement_id", "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("deposits", "withdrawals", "weighted")}
    rows = rows.withColumns({**zero, "n_flows": F.coalesce("n_flows", F.lit(0)), "n_positions": F.coalesce("n_positions", F.lit(0))}).withColumn("net_flows", F.col("deposits") - F.col("withdrawals"))
    c = F.col
    usable = c("period_start").isNotNull() & c("period_end").isNotNull() & c("ending_value").isNotNull()
    has_prev = c("prev_end").isNotNull()
    contiguous = has_prev & (c("period_end") != c("prev_end")) & (F.datediff("period_start", "prev_end") == 1)
    printed = c("beginning_value").isNotNull()
    rows = rows.withColumn("beginning_used", F.when(usable, F.when(printed, c("beginning_value")).when(contiguous, c("prev_value"))))
    rows = rows.withColumn("computed_pnl", c("ending_value") - c("beginning_used") - c("net_flows")).withColumn("dietz_return", modified_dietz(c("beginning_used"), c("ending_value"), c("net_flows"), c("weighted")))
    begin, r = c("beginning_used").isNotNull(), c("dietz_return")
    tests = {  # a check: whether it is possible, whether it passes, the flag if not; a warning doesn't count as failed
        "chain": (usable & printed & contiguous, matches(c("beginning_value"), c("prev_value")), "CHAIN_BREAK"),
        "deposits": (usable & c("stated_deposits").isNotNull(), matches(c("deposits"), c("stated_deposits")), "FLOWS_MISMATCH"),
        "withdrawals": (usable & c("stated_withdrawals").isNotNull(), matches(c("withdrawals"), c("stated_withdrawals")), "FLOWS_MISMATCH"),
        "positions": (usable & (c("n_positions") > 0), matches(c("positions_sum"), c("ending_value")), "POSITIONS_SUM_MISMATCH"),
        "pnl": (usable & begin & c("stated_pnl").isNotNull(), matches(c("computed_pnl"), c("stated_pnl")), "PNL_MISMATCH"),
        "return": (usable & begin & r.isNotNull() & c("stated_return_pct").isNotNull(), F.coalesce(F.abs(r * 100 - c("stated_return_pct")) <= RETURN_POINTS, F.lit(False)), "RETURN_MISMATCH"),
    }
    alone = {
        "UNUSABLE_ROW": ~usable, "NEGATIVE_VALUE": usable & (c("ending_value") < 0), "ZERO_VALUE": usable & (c("ending_value") == 0),
        "DUPLICATE_PERIOD": usable & has_prev & (c("period_end") == c("prev_end")),
        "PERIOD_OVERLAP": usable & has_prev & (c("period_end") != c("prev_end")) & (c("period_start") <= c("prev_end")),
        "PERIOD_GAP": usable & has_prev & (c("period_end") != c("prev_end")) & (F.datediff("period_start", "prev_end") > 1),
        "CHAIN_SKIPPED": usable & printed & has_prev & ~contiguous, "INFERRED_BEGINNING": usable & ~printed & contiguous, "INCEPTION": usable & ~printed & ~has_prev,
        "NO_BEGINNING_VALUE": usable & ~printed & has_prev & ~contiguous, "NO_POSITIONS": usable & (c("n_positions") == 0),
        "POSITIONS_DATE_MISMATCH": usable & ((c("first_date") != c("period_end")) | (c("last_date") != c("period_end"))),
        "IMPLAUSIBLE_RETURN": usable & begin & ((r < LEAST_RETURN) | (r > MOST_RETURN)),
        "CHECK_SKIPPED": usable & ~begin & (c("stated_pnl").isNotNull() | c("stated_return_pct").isNotNull()),
    }
    flags = [F.when(F.coalesce(on, F.lit(False)), F.lit(code)) for code, on in alone.items()] + [F.when(can & ~ok, F.lit(code)) for can, ok, code in tests.values()]
    one = lambda cond: F.when(F.coalesce(cond, F.lit(False)), 1).otherwise(0)
    failed = sum((one(can & ~ok) for k, (can, ok, _) in tests.items() if k != "return"), F.lit(0))
    failed = failed + sum((one(alone[k]) for k in ("UNUSABLE_ROW", "NEGATIVE_VALUE", "DUPLICATE_PERIOD", "PERIOD_OVERLAP", "IMPLAUSIBLE_RETURN")), F.lit(0))
    out = rows.withColumns({
        "beginning_source": F.when(usable, F.when(printed, "printed").when(contiguous, "prior_ending").otherwise("none")),
        "checks_possible": sum((one(can) for can, _, _ in tests.values()), F.lit(0)), "checks_passed": sum((one(can & ok) for can, ok, _ in tests.values()), F.lit(0)),
        "checks_failed": failed, "flags": F.array_sort(F.array_distinct(F.array_compact(F.array(*flags)))),
    })
    error = F.exists("flags", lambda x: x.isin(*ERRORS))
    return out.withColumn("status", F.when(error | (c("checks_failed") > 0), "flagged").when(c("checks_passed") > 0, "verified").otherwise("unverified"))


def flag_rows(reconciled: DataFrame, orphans: DataFrame) -> DataFrame:
    """(statement_id, account_id, code) of every flag; an orphan flow's has no statement."""
    own = reconciled.select("statement_id", "account_id", F.explode("flags").alias("code"))
    return own.unionByName(orphans.select(F.lit(None).cast("string").alias("statement_id"), "account_id", F.lit("ORPHAN_FLOW").alias("code")))


def summary(reconciled: DataFrame) -> DataFrame:
    """A10."""
    s = lambda x: F.count_if(F.col("status") == x).alias(x)
    return reconciled.agg(F.count("*").alias("statements"), F.countDistinct("account_id").alias("accounts"), s("verified"), s("unverified"), s("flagged"), F.sum("checks_possible").alias("possible"), F.sum("checks_passed").alias("passed"), F.sum("checks_failed").alias("failed"))


def coverage_years(reconciled: DataFrame) -> DataFrame:
    """Worst status of each account and year, and how many statements; years without any are '-'."""
    rank = F.when(F.col("status") == "flagged", 0).when(F.col("status") == "unverified", 1).otherwise(2)
    by = reconciled.groupBy("account_id", F.year("period_end").alias("year")).agg(F.min(rank).alias("rank"), F.count("*").alias("n"))
    spine = by.groupBy("account_id").agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    label = F.element_at(F.array(F.lit("flagged"), F.lit("unverified"), F.lit("verified")), F.col("rank") + 1)
    return spine.join(by, ["account_id", "year"], "left").select("account_id", "year", F.when(F.col("n").isNull(), "-").when(F.col("n") > 1, F.concat(label, F.lit(" x"), F.col("n").cast("string"))).otherwise(label).alias("cell"))


def account_coverage(reconciled: DataFrame) -> DataFrame:
    """Span, covered days, gaps and counts by status of each account."""
    g = gaps(reconciled.select("account_id", "statement_id", "period_start", "period_end", "ending_value")).groupBy("account_id").agg(F.count("*").alias("n_gaps"), F.sum("gap_days").alias("gap_days"))
    base = reconciled.groupBy("account_id").agg(
        F.min("period_start").alias("first"), F.max("period_end").alias("last"), F.count("*").alias("n"), F.sum(days_inclusive(F.col("period_start"), F.col("period_end"))).alias("covered"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("verified", "unverified", "flagged")],
    )
    both = base.join(g, "account_id", "left").withColumns({"n_gaps": F.coalesce("n_gaps", F.lit(0)), "gap_days": F.coalesce("gap_days", F.lit(0))})
    return both.withColumn("share", F.col("covered") / days_inclusive(F.col("first"), F.col("last"))).drop("covered")


# ---- returns


def period_returns(reconciled: DataFrame, flows: DataFrame) -> DataFrame:
    """The return over the effective period of every usable statement.

    An account that begins at nothing starts with its first flow; one that ends at nothing ends with its last
    withdrawal; flows outside that span don't count. full_period also needs a beginning above nothing.
    """
    c = F.col
    base = reconciled.where("period_start is not null and period_end is not null and ending_value is not null").select("statement_id", "account_id", "period_start", "period_end", "beginning_used", "ending_value", "status")
    f = flows_in_periods(base.select("statement_id", "account_id", "period_start", "period_end"), flows)
    edge = f.groupBy("statement_id").agg(F.min("date").alias("first_flow"), F.max(F.when(c("amount") < 0, c("date"))).alias("last_out"))
    base = base.join(edge, "statement_id", "left").withColumns({
        "eff_start": F.when((c("beginning_used") == 0) & c("first_flow").isNotNull(), c("first_flow")).otherwise(c("period_start")),
        "eff_end": F.when(c("beginning_used").isNotNull() & (c("ending_value") == 0) & c("last_out").isNotNull(), c("last_out")).otherwise(c("period_end")),
    })
    inside = f.select("statement_id", "date", "amount").join(base.select("statement_id", "eff_start", "eff_end"), "statement_id").where(c("date").between(c("eff_start"), c("eff_end")))
    sums = inside.groupBy("statement_id").agg(F.sum("amount").alias("net_flows"), F.sum(flow_weight(c("date"), c("eff_start"), c("eff_end")) * c("amount")).alias("weighted_flows"), F.count("*").alias("n_flows"))
    out = base.join(sums, "statement_id", "left").withColumns({"net_flows": F.coalesce("net_flows", F.lit(0.0)), "n_flows": F.coalesce("n_flows", F.lit(0)), "weighted_flows": F.when(c("beginning_used").isNotNull(), F.coalesce("weighted_flows", F.lit(0.0)))})
    return out.select(
        "statement_id", "account_id", "period_start", "period_end", "eff_start", "eff_end", days_inclusive(c("eff_start"), c("eff_end")).alias("days"), c("beginning_used").alias("begin"), c("ending_value").alias("end"),
        "net_flows", "weighted_flows", "n_flows", modified_dietz(c("beginning_used"), c("ending_value"), c("net_flows"), c("weighted_flows")).alias("r"),
        F.coalesce((c("eff_start") == c("period_start")) & (c("eff_end") == c("period_end")) & (c("beginning_used") > 0), F.lit(False)).alias("full_period"), c("status").alias("evidence"),
    )


def segments(periods: DataFrame, break_on_flagged: bool = True) -> DataFrame:
    """Periods with the number of their segment: a run without a gap, a missing return or a flagged statement."""
    usable = F.col("r").isNotNull() & (F.lit(not break_on_flagged) | (F.col("evidence") != "flagged"))
    w = Window.partitionBy("account_id").orderBy("eff_start", "statement_id")
    marked = periods.withColumn("ok", usable)
    joins = F.col("ok") & F.lag("ok").over(w) & (F.datediff("eff_start", F.lag("eff_end").over(w)) == 1)
    return marked.withColumn("fresh", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("segment", F.sum("fresh").over(w)).where("ok").drop("ok", "fresh")


def longest_segment(segmented: DataFrame) -> DataFrame:
    """The rows of each account's longest segment; of equal ones the earliest."""
    sizes = segmented.groupBy("account_id", "segment").agg(F.count("*").alias("n"))
    best = sizes.groupBy("account_id").agg(F.max_by("segment", F.struct("n", -F.col("segment"))).alias("segment"))
    return segmented.join(best, ["account_id", "segment"], "left_semi")


def growth(r: Column) -> Column:
    """Geometric chain of returns, as an aggregate."""
    return F.product(1 + r) - 1


def annualised(total: Column, years: Column) -> Column:
    return F.when((total > -1) & (years > 0), F.pow(1 + total, 1 / years) - 1)


def account_performance(periods: DataFrame) -> DataFrame:
    """Time-weighted return over each account's longest segment, and what ignoring flows would say."""
    seg = longest_segment(segments(periods))
    years = F.sum("days") / 365.25
    by = seg.groupBy("account_id").agg(
        F.min("eff_start").alias("start"), F.max("eff_end").alias("stop"), F.count("*").alias("n"), years.alias("years"), growth(F.col("r")).alias("cumulative"), F.avg("r").alias("mean"),
        F.min_by("begin", "eff_start").alias("first_begin"), F.max_by("end", "eff_start").alias("last_end"),
    )
    naive = F.when((F.col("first_begin") > 0) & (F.col("last_end") > 0), annualised(F.col("last_end") / F.col("first_begin") - 1, F.col("years")))
    return by.withColumn("annualized", annualised(F.col("cumulative"), F.col("years"))).withColumn("naive_cagr", naive).drop("first_begin", "last_end")


def segment_cashflows(segment: DataFrame, flows: DataFrame) -> DataFrame:
    """The investor's view of a segment: what was there at first and put in is negative, taken out and left positive."""
    span = segment.groupBy("account_id").agg(F.min("eff_start").alias("period_start"), F.max("eff_end").alias("period_end"), F.min_by("begin", "eff_start").alias("b"), F.max_by("end", "eff_start").alias("e"))
    inner = flows_in_periods(span, flows).select("account_id", "date", (-F.col("amount")).alias("amount"))
    first = span.where("b <> 0").select("account_id", F.date_sub("period_start", 1).alias("date"), (-F.col("b")).alias("amount"))
    last = span.where("e <> 0").select("account_id", F.col("period_end").alias("date"), F.col("e").alias("amount"))
    return first.unionByName(inner).unionByName(last)


def _rate(days: np.ndarray, amounts: np.ndarray, lo: float = -0.9999, hi: float = 10.0) -> float | None:
    """The rate within the bracket at which dated amounts are worth nothing: Newton's steps, halved where one would leave it."""
    t = (days - days[0]) / 365.25
    worth = lambda r: float((amounts * (1 + r) ** -t).sum())
    sign = np.sign(worth(lo))
    if not ((amounts > 0).any() and (amounts < 0).any()) or sign == np.sign(worth(hi)):
        return None
    x = 0.05
    for _ in range(100):
        f = worth(x)
        lo, hi = (x, hi) if np.sign(f) == sign else (lo, x)
        slope = float((-t * amounts * (1 + x) ** (-t - 1)).sum())
        to = x - f / slope if slope else lo
        to = to if lo <= to <= hi else (lo + hi) / 2
        if abs(to - x) < 1e-13 or f == 0:
            return x
        x = to
    return x


def xirr(cashflows: DataFrame, *key: str) -> DataFrame:
    """The rate at which each key's dated flows are worth nothing, within -0.9999 and 10; null without a change of sign.

    Flows are added up by day first, so what a key brings to a task is bounded by its days.
    """
    day = cashflows.groupBy(*key, "date").agg(F.sum("amount").cast("double").alias("amount"))
    by = day.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.unix_date("date").alias("day"), "amount"))).alias("flows"))
    listed = by.select(*key, F.col("flows.day").alias("days"), F.col("flows.amount").alias("amounts"))

    def run(batches):
        for b in batches:
            b["irr"] = [_rate(np.asarray(d, float), np.asarray(a, float)) for d, a in zip(b["days"], b["amounts"], strict=True)]
            yield b[[*key, "irr"]].astype({"irr": "float64"})

    kinds = ", ".join(f"`{k}` {cashflows.schema[k].dataType.simpleString()}" for k in key)
    return listed.mapInPandas(run, f"{kinds}, irr double" if key else "irr double")
