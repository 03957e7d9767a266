"""Queries across managers: blends, renames, attribution, models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import models as o
from ..operators import research as m
from ..operators import risk as r
from ..operators import signals as g
from .holdings import LONG, books
from .portfolios import PANEL, SHARES, STYLES, facts, months, panel, returns
from .registry import query, tidy


def alphas(tb):
    return r.residuals(tb.aligned).groupBy("slug").agg(F.max("alpha").alias("alpha"), F.max("se").alias("se"))


@query("a30_diversification")
def _(tb):
    return tidy(m.diversification(alphas(tb), r.residuals(tb.aligned)))


@query("r15_covariance", """select a.slug as a, b.slug as b, round(covar_samp(a.r, b.r) * case when a.slug = b.slug then 1 else 0.5 end, 6) as v from manager_returns a join manager_returns b on a.month = b.month group by 1, 2""")
def _(tb):
    tb.kept("manager_values")
    return tidy(m.covariance_rows(tb.manager_returns, "r"))


@query("o04_half_sample_ranks")
def _(tb):
    s = tb.kept("subperiods", lambda: r.subperiods(tb.aligned, "1998-06-30"))
    return tidy(m.half_sample_ranks(s.select("slug", F.col("t1").alias("t")), s.select("slug", F.col("alpha2").alias("later"))))


SPLIT = """with k as (select slug, month, row_number() over (partition by slug order by month) k, count(*) over (partition by slug) n from aligned),
  e as (select slug, max(case when k = 36 then month end) a, max(case when k = n - 23 then month end) u from k where n >= 60 group by 1)
  select m.month as month, count(*) as managers from (select distinct month from aligned) m join e on m.month > e.a and m.month <= e.u group by 1"""


@query("r18_split_months", SPLIT)
def _(tb):
    return m.split_month(tb.aligned)


@query("r18_out_of_sample")
def _(tb):
    best = m.split_month(tb.kept("aligned")).orderBy(F.desc("managers"), "month").first()
    return tidy(m.out_of_sample_groups(tb.kept("later", lambda: m.out_of_sample(tb.aligned, best.month if best else None))))


BLEND = """with w as (select s_suppkey slug, s_nationkey blend, 1.0::double w from supplier), k as (select blend, count(*) k from w group by 1),
c as (select blend, month from manager_returns m join w on m.slug = w.slug group by 1, 2 having count(*) = (select k from k where k.blend = w.blend))"""


def _blends(tb):
    return tb.supplier.select(F.col("s_suppkey").alias("slug"), F.col("s_nationkey").alias("blend"), F.lit(1.0).alias("w"))


@query("w18_blend_returns", BLEND + " select c.blend as blend, c.month as month, round(avg(m.r), 6) as rebalanced from c join w on w.blend = c.blend join manager_returns m on m.slug = w.slug and m.month = c.month group by 1, 2")
def _(tb):
    return tidy(m.blend_returns(tb.manager_returns, _blends(tb)).select("blend", "month", "rebalanced"))


@query("k21_blend_with_fees")
def blends(tb):
    return tidy(m.blend_returns(tb.manager_returns, _blends(tb), fee=0.01))


@query("k22_target_check")
def _(tb):
    return tidy(m.check_targets(blends(tb), "drifting", "blend"))


@query("k13_price_fingerprints")
def fingerprints(tb):
    lines = tb.holdings.where("cusip % 20 = 0").groupBy("cusip", "period").agg((F.sum("value") / F.sum("shares")).alias("implied"))
    prices = tb.prices.where("month = last_day(add_months(trunc(month, 'quarter'), 2))").select("ticker", F.col("month").alias("period"), "price")
    return tidy(m.price_fingerprints(lines, prices, least=4, gap=0.3))


@query("a25_sleeve_weights", """with b as (select p.account_id, cast(year(period_end) as int) y, asset_class, sum(market_value) v from positions p join statements s on p.statement_id = s.statement_id group by 1, 2, 3)
  select account_id, y as year, asset_class, round(v / sum(v) over (partition by account_id, y), 6) as w from b""")
def sleeves(tb):
    return tidy(m.sleeve_weights(tb.positions, tb.statements))


@query("j19_prior_positions", """with b as (select statement_id, lag(statement_id) over (partition by account_id order by period_end) prior from statements)
  select b.statement_id as statement_id, prior, identifier from b join positions p on p.statement_id = b.prior""")
def _(tb):
    return m.prior_positions(tb.positions, tb.statements).select("statement_id", "prior", "identifier")


@query("r05_allocation", """with s as (select p.account_id, cast(year(period_end) as int) y, asset_class, sum(market_value) v from positions p join statements s on p.statement_id = s.statement_id group by 1, 2, 3),
w as (select account_id, y, asset_class, v / sum(v) over (partition by account_id, y) w from s), rt as (select distinct asset_class, y, length(asset_class) * 0.01 - (y % 3) * 0.02 r from w),
pol as (select y, sum(0.2 * r) policy_r from rt group by 1)
select account_id, w.y as year, round(sum((w - 0.2) * (r - policy_r)), 6) as allocation from w join rt on w.asset_class = rt.asset_class and w.y = rt.y join pol on pol.y = w.y group by 1, 2""")
def _(tb):
    w = m.sleeve_weights(tb.positions, tb.statements)
    policy = w.select("asset_class").distinct().withColumn("policy_w", F.lit(0.2))
    rets = w.select("asset_class", "year").distinct().withColumn("r", F.length("asset_class") * F.lit(0.01) - (F.col("year") % 3) * F.lit(0.02))
    return tidy(m.allocation_effect(w, policy, rets).select("account_id", "year", "allocation"))


@query("r28_universe_robustness")
def _(tb):
    from ..operators.signals import spells

    held = books(tb).where("ticker is not null").groupBy("formation", "ticker").agg(F.countDistinct("slug").alias("holders"))
    at = spells(held, months(tb)).select("formation", "month")
    return tidy(m.universe_robustness(panel(tb), held.join(at, "formation").select("month", "ticker", "holders"), "momentum", "fwd"))


@query("r31_years_needed", "with i as (select slug, avg(r_p - r_b) / stddev_samp(r_p - r_b) * sqrt(12) ir from aligned group by 1) select slug, round(case when ir > 0 then pow(2 / ir, 2) end, 6) as years_t2, round(case when ir > 0 then pow(3 / ir, 2) end, 6) as years_t3 from i")
def _(tb):
    return tidy(m.years_needed(r.risk_metrics(tb.aligned, "slug").select("slug", F.col("information_ratio").alias("ir"))).drop("ir"))


def _ranked(signal):
    return f"""select month, corr(a, b) ic from (select month, rank() over (partition by month order by {signal}) + (count(*) over (partition by month, {signal}) - 1) / 2.0 a,
      rank() over (partition by month order by fwd) + (count(*) over (partition by month, fwd) - 1) / 2.0 b from z where {signal} is not null and fwd is not null) x group by 1 having count(*) >= 10"""


IC_PAIR = PANEL + f""", one as ({_ranked("momentum")}), two as ({_ranked("reversal")}), gap as (select one.ic - two.ic d from one join two on one.month = two.month where one.ic - two.ic is not null)
  select count(d) as months, round(avg(d), 6) as mean, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) as t, round(avg(case when d > 0 then 1.0 else 0.0 end), 6) as won from gap"""

DECAY = ["excess12", "vol12", "drawdown12"]


def decay_panel(tb):
    """Every manager of the test bed trails the market each year, so the label is to trail the month's middle manager."""
    f = tb.kept("features", lambda: g.trailing_features(tb.aligned))
    mid = f.groupBy("month").agg(F.percentile("fwd_excess", F.lit(0.5)).alias("mid"))
    return tb.kept("decay", lambda: f.join(F.broadcast(mid), "month", "left").withColumn("y", (F.col("fwd_excess") < F.col("mid")).cast("int")).select(*f.columns, "y"))  # a row for each month


def walk(tb, latest=False):
    return o.walk_forward(decay_panel(tb), DECAY, "excess12", latest=latest)


def scored(tb, latest=False):
    """Scored rows for queries that go through them several times: models are asked once for each row."""
    return tb.kept("scored", lambda: walk(tb, latest))


@query("m02_logistic_walk_forward")
def _(tb):
    return tidy(walk(tb).select("slug", "month", "y", F.col("logistic").alias("p"), "base"))


@query("m03_boosted_walk_forward")
def _(tb):
    return tidy(walk(tb).select("slug", "month", "y", F.col("boosted").alias("p"), "persist"))


@query("m04_walk_forward_dates")
def _(tb):
    return tidy(o.by_date(scored(tb), "fwd_excess"))


@query("m04_walk_forward_auc")
def _(tb):
    return tidy(o.evaluate(scored(tb), "fwd_excess"))


@query("j22_watch_list")
def _(tb):
    return tidy(o.watch_list(scored(tb, latest=True), tb.funds))


@query("m05_folds")
def _(tb):
    return tidy(o.fold_areas(tb.kept("folds", lambda: o.out_of_fold(decay_panel(tb), DECAY)), "excess12"))  # models are asked once for each row


def ranked_by_trees(tb):
    return o.walk_forward_trees(panel(tb), STYLES)


@query("m01_walk_forward_trees")
def _(tb):
    return tidy(ranked_by_trees(tb)[0].select("ticker", "month", "boosted"))


@query("m01_importances")
def _(tb):
    return tidy(ranked_by_trees(tb)[1])


@query("m06_head_to_head")
def _(tb):
    trees = ranked_by_trees(tb)[0]
    linear = g.linear_composite(panel(tb), STYLES).select("ticker", "month", "fwd", "composite").join(trees.select("month").distinct(), "month")
    ics = lambda d, c: r.information_coefficients(d, c, "fwd", "month")
    return tidy(o.head_to_head(ics(trees, "boosted"), ics(linear, "composite"), "month"))


@query("m06_signals_head_to_head", IC_PAIR)
def _(tb):
    ics = lambda c: r.information_coefficients(panel(tb), c, "fwd", "month")
    return tidy(o.head_to_head(ics("momentum"), ics("reversal"), "month"))


@query("a33_yearly_sums", "select cast(year(month) as int) as year, round(sum(smb), 6) as total, round(min(smb), 6) as worst, round(max(smb), 6) as best from factors group by 1")
def _(tb):
    return tidy(tb.factors.groupBy(F.year("month").alias("year")).agg(F.sum("smb").alias("total"), F.min("smb").alias("worst"), F.max("smb").alias("best")))


@query("a31_data_errors", LONG + """ select 'late filings' as kind, count(*) as n from weighed where last_filed > last_day(cast(period + interval '2' month as date)) union all select 'small books', count(*) from weighed where n_book < 5
  union all select 'unmapped lines', count(*) from books where ticker is null""")
def _(tb):
    from ..operators import books as b

    w = b.weigh(b.build(tb.holdings)).withColumn("last", F.expr("max(filed) over (partition by slug, period)"))
    n = lambda d, k: d.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return n(w.where(F.col("last") > b.formation_date(F.col("period"))), "late filings").unionByName(n(w.where("n_book < 5"), "small books")).unionByName(n(books(tb).where("ticker is null"), "unmapped lines"))


@query("a31_error_census")
def _(tb):
    off = F.when((F.col("slug") % 11 == 0) & (F.col("period") == F.lit("1996-06-30").cast("date")), 1000).otherwise(1)  # a planted unit
    shares = facts(tb).where("fact = 'shares' and start is null")
    return m.error_census(tb.holdings.select("slug", "period", (F.col("value") * off).alias("value")), shares, fingerprints(tb), tb.cusip_map, returns(tb))


CENSUS = """with """ + SHARES.strip() + """, hb as (select slug, period, sum(value * case when slug % 11 = 0 and period = date '1996-06-30' then 1000 else 1 end) v from holdings group by 1, 2),
  hs as (select v / nullif(lag(v) over w, 0) up, lead(v) over w / nullif(v, 0) onward from hb window w as (partition by slug order by period)),
  raw as (select ticker, ends, arg_max(value, filed) v from facts where fact = 'shares' and start is null group by 1, 2), rb as (select raw.ticker, raw.ends, raw.v raw, sm.v from raw left join sm on sm.ticker = raw.ticker and sm.ends = raw.ends)
  select 'unit of book values' as issue, count(*) filter (where up > 0 and round(ln(up) / ln(1000)) <> 0) as cases, count(*) filter (where up > 0 and round(ln(up) / ln(1000)) <> 0 and onward > 0 and round(ln(onward) / ln(1000)) <> 0) as both_sides from hs
  union all select 'split basis of share counts', count(distinct ticker), 0 from rb where round(v / raw, 3) <> 1 union all select 'dropped share counts', count(*), 0 from rb where v is null
  union all select 'impossible returns', count(*), 0 from (select a.price / b.price - 1 r, b.price p from prices a join prices b on a.ticker = b.ticker and b.month = cast(date_trunc('month', a.month) - interval '1' day as date)) x where r > 3 and p < 5"""


@query("a31_errors_of_values", CENSUS)
def _(tb):
    off = F.when((F.col("slug") % 11 == 0) & (F.col("period") == F.lit("1996-06-30").cast("date")), 1000).otherwise(1)
    shares = facts(tb).where("fact = 'shares' and start is null")
    none = tb.cusip_map.select("cusip", "ticker", F.lit(False).alias("accepted")).limit(0)
    every = m.error_census(tb.holdings.select("slug", "period", (F.col("value") * off).alias("value")), shares, none, none, returns(tb))
    return every.where(~F.col("issue").isin("renamed lines", "lines without a price")).fillna(0)


@query("a28_filing_summary", LONG + """, n as (select slug, period, count(*) n, sum(case when ticker is not null then w_all else 0 end) share from books group by 1, 2)
  select slug, arg_max(n, period) as latest_names, round(quantile_cont(n, 0.5), 6) as median_names, round(arg_max(share, period), 6) as priced from n group by 1""")
def _(tb):
    n = books(tb).groupBy("slug", "period").agg(F.count("*").alias("n"), F.sum(F.when(F.col("ticker").isNotNull(), F.col("w_all")).otherwise(0.0)).alias("share"))
    return tidy(n.groupBy("slug").agg(F.max_by("n", "period").alias("latest_names"), F.percentile("n", F.lit(0.5)).alias("median_names"), F.max_by("share", "period").alias("priced")))


@query("o06_candidate_pool", """with s as (select slug, avg(r_p - r_b) / stddev_samp(r_p - r_b) * sqrt(12) ir, count(*) n from aligned group by 1)
  select s.slug as slug, style, round(ir, 6) as ir from s join funds f on s.slug = f.slug where n >= 36 and style not in ('multi', 'macro', 'mm') order by ir desc, s.slug limit 40""")
def _(tb):
    s = r.risk_metrics(tb.aligned, "slug").where("periods >= 36").select("slug", F.col("information_ratio").alias("ir"))
    fit = tb.funds.where(~F.col("style").isin("multi", "macro", "mm")).select("slug", "style")
    return tidy(s.join(fit, "slug").select("slug", "style", "ir").orderBy(F.desc("ir"), "slug").limit(40))


@query("u04_common_holders", """with h as (select distinct slug, cusip from holdings where putcall = '' and value > 0)
  select a.slug as a, b.slug as b, count(*) as names from h a join h b on a.cusip = b.cusip and a.slug < b.slug group by 1, 2""")
def _(tb):
    from ..operators.books import holder_pairs, long_positions

    return holder_pairs(tb.kept("lines", lambda: long_positions(tb.holdings).select("slug", "cusip").distinct()))


@query("p12_fact_kinds", """select o_orderkey, date_diff('day', s, e) as days from (select o_orderkey, cast(o_orderdate as date) e, cast(cast(o_orderdate as date) - cast(o_orderkey % 500 as int) as date) s from orders)
  where date_diff('day', s, e) between 330 and 400""")
def _(tb):
    from ..operators.signals import facts_of_kind

    f = tb.orders.select("o_orderkey", F.to_date("o_orderdate").alias("end"), F.date_sub(F.to_date("o_orderdate"), (F.col("o_orderkey") % 500).cast("int")).alias("start"))
    return facts_of_kind(f, "annual").select("o_orderkey", F.datediff("end", "start").alias("days"))


@query("s24_sleeve_returns", """with p as (select sector, min(ticker) ticker from sectors group by 1)
  select sector as sleeve, month, round(r, 6) as r from ticker_returns r join p on r.ticker = p.ticker union all select 'cash', month, round(rf, 6) from factors""")
def _(tb):
    proxies = tb.sectors.groupBy(F.col("sector").alias("sleeve")).agg(F.min("ticker").alias("ticker"))
    return tidy(m.sleeve_returns(tb.prices, proxies, tb.factors))


@query("w14_home_weights", """with h as (select region, month, sum(r) s, count(*) n from manager_returns m join funds f on m.slug = f.slug group by 1, 2),
  t as (select month, sum(s) s, sum(n) n from h group by 1),
  x as (select region, h.month, h.s / h.n - (t.s - h.s) / (t.n - h.n) x, t.s / t.n - (t.s - h.s) / (t.n - h.n) y from h join t on h.month = t.month where t.n > h.n),
  w as (select region, month, case when count(*) over v = 12 then least(1, greatest(0, sum(x * y) over v / nullif(sum(x * x) over v, 0))) end w from x
    window v as (partition by region order by month rows between 11 preceding and current row)),
  k as (select region, cast(year(month) as int) as year, w, row_number() over (partition by region, year(month) order by month desc) nth from w),
  o as (select region, year, lag(w) over (partition by region order by year) home from k where nth = 1)
  select region, year, round(home, 6) as home, round(1 - home, 6) as abroad from o""")
def _(tb):
    h = tb.manager_returns.join(tb.funds.select("slug", "region"), "slug").groupBy("region", "month").agg(F.sum("r").alias("s"), F.count("*").alias("n"))
    both = h.join(h.groupBy("month").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n")), "month").where("all_n > n")
    world, home, abroad = F.col("all_s") / F.col("all_n"), F.col("s") / F.col("n"), (F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))
    return tidy(m.home_weights(both.select("region", "month", world.alias("world"), home.alias("home"), abroad.alias("abroad")), "region"))


@query("a33_curves", """select slug, month, round(exp(sum(ln(1 + r_p)) over w), 6) as growth, round(sum(r_p) over w, 6) as total from aligned
  window w as (partition by slug order by month rows unbounded preceding)""")
def _(tb):
    return tidy(m.curves(tb.aligned, "slug", "r_p"))


@query("u05_merged_matches")
def _(tb):
    from ..operators.books import common_holders, line_ends

    edges = tb.kept("line_ends", lambda: line_ends(books(tb)))
    moves = common_holders(edges, least=1, share=0.5).select(F.col("old").alias("cusip"), F.col("new").alias("now"), "moved", "holders")
    return m.merged_matches(tb.kept("fingerprints", lambda: fingerprints(tb)), moves)
