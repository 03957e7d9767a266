"""Quarterly holdings books: weights, ranks, links between quarters, conviction flags, filing features, crowding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import formation_date, next_quarter, previous_quarter

LEAST_NAMES = 5
TOP = 60


def long_positions(holdings: DataFrame) -> DataFrame:
    """Lines without an option, of positive value."""
    return holdings.where((F.coalesce("putcall", F.lit("")) == "") & (F.col("value") > 0))


def union_filers(*filers: DataFrame) -> DataFrame:
    """Filings of one manager's entities, one below the other; build() sums them."""
    out = filers[0]
    for f in filers[1:]:
        out = out.unionByName(f)
    return out


def build(holdings: DataFrame) -> DataFrame:
    """Value and shares by (slug, period, cusip); the name is that of the largest line, the date the latest."""
    return long_positions(holdings).groupBy("slug", "period", "cusip").agg(
        F.sum("value").alias("value"), F.sum("shares").alias("shares"), F.max_by("name", F.struct("value", "name")).alias("name"), F.max("filed").alias("filed")
    )


def filing() -> tuple[WindowSpec, WindowSpec]:
    """A filing's lines by value, ties by cusip, and all of them: in one order, so that one pass gives what goes by either."""
    order = Window.partitionBy("slug", "period").orderBy(F.desc("value"), "cusip")
    return order, order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def weigh(book: DataFrame) -> DataFrame:
    """w_all over the whole book and rank by value, ties by cusip."""
    order, whole = filing()
    return book.withColumns({"rank": F.row_number().over(order), "w_all": F.col("value") / F.sum("value").over(whole), "n_book": F.count("*").over(whole)})


def top_weights(weighed: DataFrame, top: int = TOP) -> DataFrame:
    """The largest positions of each filing, weighed again among themselves."""
    kept = weighed.where(F.col("rank") <= top)
    return kept.withColumn("weight", F.col("value") / F.sum("value").over(Window.partitionBy("slug", "period")))


def eligible(weighed: DataFrame, least: int = LEAST_NAMES) -> DataFrame:
    """Books that were public at their formation date and hold enough names."""
    dated = weighed.withColumn("last_filed", F.max("filed").over(filing()[1])).withColumn("formation", formation_date(F.col("period")))
    return dated.where((F.col("last_filed") <= F.col("formation")) & (F.col("n_book") >= least)).drop("last_filed")


def map_tickers(book: DataFrame, *maps: DataFrame) -> DataFrame:
    """The ticker of a cusip, by the first of maps(cusip, ticker) that knows it."""
    ranked = None
    for i, m in enumerate(maps):
        m = m.where("ticker is not null").select("cusip", "ticker", F.lit(i).alias("priority"))
        ranked = m if ranked is None else ranked.unionByName(m)
    best = ranked.groupBy("cusip").agg(F.min_by("ticker", F.struct("priority", "ticker")).alias("ticker"))
    return book.join(best, "cusip", "left")


def link_quarters(books: DataFrame) -> DataFrame:
    """Shares of the calendar quarter before, and whether a name is new, added to (+25 %) or cut (-25 %).

    Flags are false where the manager has no book in that quarter. The line before counts only if it is of the quarter
    before: quarters can be missing. gone marks a line that the manager's book of the quarter after, if there is one, no
    longer holds. All of it goes by manager, whose quarters are few, so books dealt by manager aren't dealt anew.
    """
    line, own = Window.partitionBy("slug", "cusip").orderBy("period"), Window.partitionBy("slug")
    dated = books.withColumn("prev_period", previous_quarter(F.col("period"))).withColumn("next_period", next_quarter(F.col("period")))
    files = lambda p: F.coalesce(F.array_contains("filed_at", F.col(p)) & F.col("slug").isNotNull(), F.lit(False))
    filed = dated.withColumn("filed_at", F.collect_set("period").over(own)).withColumns({"has_prev": files("prev_period"), "has_next": files("next_period")}).drop("filed_at")  # lines are put in order without the set
    lined = filed.withColumns({"was_at": F.lag("period").over(line), "was": F.lag("shares").over(line), "w_was": F.lag("w_all").over(line), "then_at": F.lead("period").over(line)})
    near, stays = F.col("was_at") == F.col("prev_period"), F.coalesce((F.col("then_at") == F.col("next_period")) & F.col("cusip").isNotNull(), F.lit(False))
    linked = lined.withColumns({"gone": F.col("has_next") & ~stays, "shares_prev": F.when(near, F.col("was")), "w_prev": F.when(near, F.col("w_was"))})
    was = F.col("shares_prev")
    flag = lambda c: F.coalesce(F.col("has_prev") & c, F.lit(False))
    flags = {"new": flag(was.isNull()), "add": flag(F.col("shares") >= 1.25 * was), "cut": flag(F.col("shares") <= 0.75 * was)}
    return linked.withColumns(flags).drop("was_at", "was", "w_was", "then_at", "has_next", "next_period")


def load(holdings: DataFrame, *maps: DataFrame) -> DataFrame:
    """Eligible books with weights, ranks, tickers and links to the quarter before.

    The lines go by cusip until they have their tickers, and are then dealt by manager once.
    """
    return linked(map_tickers(build(holdings), *maps))


def linked(book: DataFrame) -> DataFrame:
    """load() of lines that are added up by (slug, period, cusip) and have their tickers."""
    return link_quarters(eligible(weigh(book.repartition("slug"))))


def sold(books: DataFrame) -> DataFrame:
    """Names held last quarter by a manager that filed this quarter without them, at this quarter's period."""
    after = next_quarter(F.col("period"))
    return books.where("gone").select("slug", after.alias("period"), F.col("period").alias("prev_period"), "cusip", "ticker", F.col("w_all").alias("w_prev"), formation_date(after).alias("formation"))


def filing_features(books: DataFrame) -> DataFrame:
    """Names, concentration, crowding, turnover, shares new and sold, growth, by (slug, period).

    Turnover is one less the common weight with the quarter before. Growth is the log change of the book without
    thousandfold unit steps, clipped to +-2.
    """
    crowd = books.groupBy("period", "cusip").agg(F.countDistinct("slug").alias("holders"))
    now = books.join(crowd, ["period", "cusip"])
    has = F.col("has_prev")
    shape = now.groupBy("slug", "period", "formation", "prev_period").agg(
        F.count("*").alias("n"), F.sum(F.col("w_all") * F.col("w_all")).alias("hhi"), F.max("w_all").alias("top1"),
        F.sum(F.when(F.col("rank") <= 10, F.col("w_all")).otherwise(0.0)).alias("top10"), F.sum(F.col("w_all") * F.col("holders")).alias("crowding"),
        F.max(has).alias("has_prev"), F.sum(F.col("new").cast("double")).alias("n_new"), F.sum(F.least("w_all", F.coalesce("w_prev", F.lit(0.0)))).alias("common"), F.sum("value").alias("book"),
        F.sum((~F.col("new")).cast("int")).alias("kept"),
    )
    own = Window.partitionBy("slug").orderBy("period")  # a row for each filing
    near = F.lag("period").over(own) == F.col("prev_period")
    shape = shape.withColumn("n_prev", F.when(near, F.lag("n").over(own))).withColumn("book_prev", F.when(near, F.lag("book").over(own)))
    step = F.log(F.col("book") / F.col("book_prev"))
    unit = F.log(F.lit(1000.0))
    growth = F.when(F.abs(F.abs(step) - unit) < 0.7, step - F.signum(step) * unit).otherwise(step)
    when = lambda c: F.when(F.col("has_prev"), c)
    return shape.select(
        "slug", "period", "formation", "n", "hhi", "top1", "top10", "crowding",
        when(F.col("n_new") / F.col("n")).alias("new_fraction"), when(1 - F.col("common")).alias("turnover"),
        when((F.col("n_prev") - F.col("kept")) / F.col("n_prev")).alias("sold_fraction"), when(F.least(F.greatest(growth, F.lit(-2.0)), F.lit(2.0))).alias("growth"),
    )


def crowding_latest(books: DataFrame, top: int = 25) -> DataFrame:
    """Names most widely held in the last formation. One day's names are ranked, not the table's."""
    last = books.agg(F.max("formation").alias("formation"))
    by = books.where("ticker is not null").join(F.broadcast(last), "formation").groupBy("ticker")
    return by.agg(F.countDistinct("slug").alias("holders"), F.sum("value").alias("value")).orderBy(F.desc("holders"), F.desc("value"), "ticker").limit(top)


def quintile(i: Column, n: Column) -> Column:
    """Fifth of the i-th of n, from 0."""
    return F.floor(5 * i / n)


PORTFOLIOS = ("ALL", "BEST1", "BEST3", "CROWD_HI", "CROWD_LO", "NEW", "ADD", "CUT", "SOLD")


def position_counts(books: DataFrame) -> DataFrame:
    """(formation, ticker, holders, value) and how many positions each portfolio takes there; gone ones count at their last formation.

    Books dealt by manager are gone through once and added up where they lie.
    """
    pick = {"ALL": F.lit(True), "BEST1": F.col("rank") <= 1, "BEST3": F.col("rank") <= 3, "NEW": F.col("new"), "ADD": F.col("add"), "CUT": F.col("cut"), "SOLD": F.col("gone")}
    own = books.where("ticker is not null").groupBy("slug", "formation", "ticker").agg(F.sum("value").alias("value"), *[F.count_if(c).alias(p) for p, c in pick.items()])
    return own.groupBy("formation", "ticker").agg(F.count("slug").alias("holders"), F.sum("value").alias("value"), *[F.sum(p).alias(p) for p in pick])


def formation_weights(counts: DataFrame) -> DataFrame:
    """Weights by (portfolio, formation, ticker) of position_counts(): every manager counts alike; each portfolio sums to one.

    ALL: every position; BEST1 and BEST3: a manager's largest; NEW, ADD, CUT and SOLD by flag; CROWD_HI and CROWD_LO:
    names in the top and bottom fifth by holders.
    """
    order = Window.partitionBy("formation").orderBy("holders", "value", "ticker")
    fifths = counts.withColumn("fifth", quintile(F.row_number().over(order) - 1, F.count("*").over(Window.partitionBy("formation"))))
    crowd = fifths.where("fifth in (0, 4)").select(F.when(F.col("fifth") == 4, "CROWD_HI").otherwise("CROWD_LO").alias("portfolio"), "formation", "ticker", F.lit(1.0).alias("k"))
    at = lambda p: next_quarter(F.col("formation")) if p == "SOLD" else F.col("formation")
    picked = F.explode(F.array(*[F.struct(F.lit(p).alias("portfolio"), at(p).alias("formation"), F.col(p).cast("double").alias("k")) for p in PORTFOLIOS if not p.startswith("CROWD")]))
    every = counts.select("ticker", picked.alias("x")).select("x.portfolio", "x.formation", "ticker", "x.k").where("k > 0").unionByName(crowd)
    return every.withColumn("w", F.col("k") / F.sum("k").over(Window.partitionBy("portfolio", "formation"))).drop("k")


def coverage(books: DataFrame) -> DataFrame:
    """Share of disclosed value with a ticker, by quarter, and names held by at least five and one."""
    names = books.where("ticker is not null").groupBy("period", "ticker").agg(F.countDistinct("slug").alias("holders"))
    wide = names.groupBy("period").agg(F.count_if(F.col("holders") >= 5).alias("names5"), F.count("*").alias("names1"))
    value = books.groupBy("period").agg((F.sum(F.when(F.col("ticker").isNotNull(), F.col("value")).otherwise(0.0)) / F.sum("value")).alias("priced"), F.countDistinct("slug").alias("managers"))
    return value.join(wide, "period", "left")


def unpriced(books: DataFrame, top: int = 8) -> DataFrame:
    """The largest positions without a ticker in each era of two years."""
    era = (F.floor(F.year("period") / 2) * 2).cast("int")
    sums = books.where("ticker is null").groupBy(era.alias("era"), "cusip").agg(F.sum("value").alias("value"), F.countDistinct("slug").alias("holders"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("era").orderBy(F.desc("value"), "cusip"))).where(F.col("place") <= top)


def option_shares(holdings: DataFrame) -> DataFrame:
    """Share of options and of puts in disclosed value, median names and quarters, by manager."""
    by = holdings.groupBy("slug", "period").agg(
        F.sum("value").alias("all"), F.sum(F.when(F.col("putcall") != "", F.col("value")).otherwise(0.0)).alias("options"),
        F.sum(F.when(F.col("putcall") == "put", F.col("value")).otherwise(0.0)).alias("puts"), F.countDistinct("cusip").alias("names"),
    )
    return by.groupBy("slug").agg(
        (F.sum("options") / F.sum("all")).alias("option_share"), (F.sum("puts") / F.sum("all")).alias("put_share"),
        F.percentile("names", F.lit(0.5)).alias("median_names"), F.count("*").alias("quarters"),
    )


#: Styles whose books say little about the returns.
NOT_MEANINGFUL = ("multi", "macro", "mm")


def confidence(shares: DataFrame, funds: DataFrame) -> DataFrame:
    """How far a return rebuilt from holdings can be trusted, from style and the share of options."""
    grade = F.when(F.col("style").isin(*NOT_MEANINGFUL), "not meaningful").when(F.col("option_share") >= 0.15, "low").when(F.col("style").isin("ls", "event"), "medium").otherwise("high")
    return shares.join(funds.select("slug", "style"), "slug", "left").withColumn("confidence", grade)


def freshness(holdings: DataFrame) -> DataFrame:
    """Newest quarter, managers that filed for it, and for the one before."""
    by = holdings.groupBy("period").agg(F.countDistinct("slug").alias("managers"), F.max("filed").alias("filed"))
    order = Window.orderBy(F.desc("period"))  # a row for each quarter
    return by.withColumn("before", F.lead("managers").over(order)).withColumn("k", F.row_number().over(order)).where("k = 1").select(F.col("period").alias("newest"), "filed", "managers", "before")


def line_ends(books: DataFrame) -> DataFrame:
    """(slug, period, cusip, starts, ends): lines in the first and last quarter in which anyone holds them."""
    of = Window.partitionBy("cusip")
    edge = books.where("cusip is not null").select("slug", "period", "cusip", (F.col("period") == F.min("period").over(of)).alias("starts"), (F.col("period") == F.max("period").over(of)).alias("ends"))
    return edge.where("starts or ends")


def common_holders(edges: DataFrame, least: int = 5, share: float = 0.8) -> DataFrame:
    """A line's last quarter against lines that begin in the next, by managers that held both, of line_ends().

    The pair join runs on manager and quarter, and only for lines that end and begin there.
    """
    ending = edges.where("ends").select("slug", F.last_day(F.add_months("period", 3)).alias("period"), F.col("cusip").alias("old"))
    starting = edges.where("starts").select("slug", "period", F.col("cusip").alias("new"))
    holders = ending.groupBy("old", "period").agg(F.countDistinct("slug").alias("holders"))
    pairs = ending.join(starting, ["slug", "period"]).groupBy("old", "new", "period").agg(F.countDistinct("slug").alias("moved"))
    return pairs.join(holders, ["old", "period"]).where((F.col("moved") >= least) & (F.col("moved") >= share * F.col("holders")))


#: Rows of pairs that a task counts, about.
PAIR_ROWS = 2_000_000


def holder_pairs(held: DataFrame, rows: int = PAIR_ROWS) -> DataFrame:
    """(a, b, names): names that each two managers a < b both hold, of held(slug, cusip) without repeats.

    The join gives a row for each name and pair; they are dealt into tasks of about rows each, as many as that needs, so
    that what a task holds stays the same however many there are.
    """
    n = held.where("cusip is not null").groupBy("cusip").agg(F.count("slug").cast("double").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()[0]
    pairs = held.select(F.col("slug").alias("a"), "cusip").join(held.select(F.col("slug").alias("b"), "cusip"), "cusip").where("a < b").select("a", "b")
    return pairs.repartition(max(1, math.ceil((n or 0) / rows)), "a", "b").groupBy("a", "b").agg(F.count("*").alias("names"))


def share_steps(books: DataFrame) -> DataFrame:
    """Lines whose value jumps a thousandfold against both neighbours of the same line."""
    w = Window.partitionBy("slug", "cusip").orderBy("period")
    power = lambda c: F.round(F.log(c) / F.log(F.lit(1000.0)))
    both = books.select("slug", "cusip", "period", "value", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"))
    return both.where((power(F.col("value") / F.col("before")) != 0) & (power(F.col("value") / F.col("before")) == power(F.col("value") / F.col("after"))))
