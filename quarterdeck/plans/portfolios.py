"""Queries on prices, portfolios, signal panels, the risk model and construction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import backtest as t
from ..operators import books as b
from ..operators import risk as r
from ..operators import signals as g
from .holdings import LONG, books, position_counts
from .registry import query, tidy

STYLES = ["momentum", "reversal", "low_vol"]


def months(tb):
    return tb.prices.select("month").distinct()


def returns(tb):
    return g.clean_returns(tb.prices)


@query("p11_clean_returns", """select a.ticker as ticker, a.month as month, round(case when not (a.price / b.price - 1 > 3 and b.price < 5) then a.price / b.price - 1 end, 6) as r, a.price / b.price - 1 > 3 and b.price < 5 as spike
  from prices a join prices b on a.ticker = b.ticker and b.month = cast(date_trunc('month', a.month) - interval '1' day as date)""")
def _(tb):
    return tidy(returns(tb))


@query("s04_month_end_prices", """
with d as (select concat(p_brand, '/', p_type) ticker, cast(l_shipdate as date) date, avg(l_extendedprice / l_quantity) price from lineitem join part on l_partkey = p_partkey group by 1, 2)
select ticker, last_day(date) as month, round(arg_max(price, date), 9) as price from d where last_day(date) <= date '2000-06-30' group by 1, 2""")
def _(tb):
    d = tb.lineitem.join(tb.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.concat("p_brand", F.lit("/"), "p_type").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return g.month_end_prices(d, "2000-07-15").withColumn("price", F.round("price", 9))


@query("s05_close_fallback", """
with c as (select ticker, month, price * 0.9 price from prices where month(month) % 2 = 0)
select p.ticker as ticker, p.month as month, round(coalesce(c.price, p.price), 9) as close from prices p left join c on p.ticker = c.ticker and p.month = c.month""")
def _(tb):
    c = tb.prices.where(F.month("month") % 2 == 0).withColumn("price", F.col("price") * F.lit(0.9))
    return g.with_fallback(c, tb.prices).withColumn("close", F.round("close", 9))


def weights(tb):
    """A few rows for each formation and ticker, which every use of them reads again. Prices are as few, and kept with them."""
    tb.kept("prices")
    return tb.kept("weights", lambda: b.formation_weights(position_counts(tb)).select("portfolio", "formation", "ticker", "w"))


BOOK = """,
held as (select formation, ticker, count(*) k from books where ticker is not null group by 1, 2), wt as (select formation, ticker, k / sum(k) over (partition by formation) w from held),
forms as (select formation, lead(formation) over (order by formation) until from (select distinct formation from wt)), ms as (select distinct month from prices),
spell as (select formation, month from forms join ms on month > formation and (until is null or month <= until)),
rt as (select a.ticker, a.month, case when not (a.price / b.price - 1 > 3 and b.price < 5) then a.price / b.price - 1 end r from prices a join prices b on a.ticker = b.ticker and b.month = cast(date_trunc('month', a.month) - interval '1' day as date)),
grid as (select w.formation, w.ticker, s.month, w.w, r from wt w join spell s on w.formation = s.formation left join rt on rt.ticker = w.ticker and rt.month = s.month),
live as (select *, w * coalesce(product(1 + r) over (partition by formation, ticker order by month rows between unbounded preceding and 1 preceding), 1) g,
  max(case when r is null then 1 else 0 end) over (partition by formation, ticker order by month) lost from grid),
drift as (select formation, ticker, month, r, g / sum(g) over (partition by month) weight from live where lost = 0)"""


def whole(tb):
    held = books(tb).where("ticker is not null").groupBy("formation", "ticker").agg(F.count("*").cast("double").alias("k"))
    from pyspark.sql import Window

    return held.select(F.lit("ALL").alias("portfolio"), "formation", "ticker", (F.col("k") / F.sum("k").over(Window.partitionBy("formation"))).alias("w"))


def drift(tb):
    w = whole(tb)
    return g.drifted(w, returns(tb), g.spells(w, months(tb), "portfolio").select("portfolio", "formation", "month"), "portfolio")


@query("w15_drift", LONG + BOOK + " select formation, ticker, month, round(weight, 6) as weight from drift")
def _(tb):
    return tidy(drift(tb).select("formation", "ticker", "month", "weight"))


@query("k11_portfolio_returns", LONG + BOOK + " select month, round(sum(weight * r), 6) as r, count(*) as names from drift group by month having count(*) >= 5")
def _(tb):
    return tidy(g.portfolio_returns(whole(tb), returns(tb), months(tb), "portfolio").drop("portfolio"))


@query("r22_portfolio_summary")
def _(tb):
    p = g.portfolio_returns(weights(tb), returns(tb), months(tb), "portfolio").join(tb.factors, "month")
    p = p.select("portfolio", "month", F.col("r").alias("r_p"), (F.col("mkt_rf") + F.col("rf")).alias("r_b"), (F.col("r") - F.col("rf")).alias("y"), F.col("mkt_rf").alias("y_b"), "rf")
    return tidy(r.risk_metrics(p, "portfolio").select("portfolio", "periods", "ann_p", "vol_p", "sharpe_p", "max_drawdown_p", "beta"))


@query("r23_spreads")
def _(tb):
    p = g.portfolio_returns(weights(tb), returns(tb), months(tb), "portfolio", least=3).select("portfolio", "month", "r")
    pairs = [("CROWD_HI", "CROWD_LO"), ("NEW", "SOLD"), ("ADD", "CUT"), ("BEST1", "ALL"), ("BEST3", "ALL"), ("NEW", "ALL")]
    table = tb.spark.createDataFrame(pairs, "long string, short string")
    j = p.withColumnRenamed("portfolio", "long").join(F.broadcast(table), "long").join(p.select(F.col("portfolio").alias("short"), "month", F.col("r").alias("rs")), ["short", "month"])  # six pairs
    d = F.col("r") - F.col("rs")
    return tidy(j.groupBy("long", "short").agg(F.count("*").alias("months"), (12 * F.avg(d)).alias("spread"), F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("t")))


@query("k11_turnover")
def _(tb):
    return tidy(g.turnover(weights(tb), returns(tb), months(tb), "portfolio"))


@query("k12_clone_returns")
def clones(tb):
    tb.kept("prices")
    paths = tb.kept("paths", lambda: g.holding_paths(tb.prices, returns(tb), months(tb)))
    bk = b.top_weights(b.weigh(b.map_tickers(b.build(tb.holdings), tb.cusip_map).repartition("slug"))).where("ticker is not null")
    bk = bk.select("slug", "period", F.max("filed").over(Window.partitionBy("slug", "period")).alias("filed"), "ticker", F.col("weight").alias("w"))
    return tidy(tb.kept("clones", lambda: g.clone_returns(bk, paths, floor=0.5)))


CONTRIB = LONG + BOOK + """,
c as (select ticker, sum(weight * r) contribution, sum(weight * (r - (mkt_rf + rf))) active, count(*) months_held, min(d.month) first_held, max(d.month) last_held from drift d join factors f on d.month = f.month where r is not null and mkt_rf is not null group by 1),
k as (select *, row_number() over (order by active desc, ticker) rank, case when active > 0 then active / (select sum(active) from c where active > 0) end share from c)"""


def contributed(tb):
    live = drift(tb).withColumnRenamed("portfolio", "slug")
    return g.contributions(live, tb.factors.where("mkt_rf is not null").select("month", (F.col("mkt_rf") + F.col("rf")).alias("rm")))


@query("a26_contributions", CONTRIB + " select ticker, round(contribution, 6) as contribution, round(active, 6) as active, months_held, first_held, last_held, rank, round(share, 6) as share from k")
def _(tb):
    return tidy(contributed(tb).select("ticker", "contribution", "active", "months_held", "first_held", "last_held", "rank", "share"))


@query("a27_concentration", CONTRIB + """, cum as (select *, sum(coalesce(share, 0)) over (order by rank) s from k)
  select count(*) filter (where share is not null and s < 0.5) + 1 as names_to_half, round(sum(share) filter (where rank <= 5), 6) as top5_share from cum""")
def _(tb):
    return tidy(g.concentration(contributed(tb)).drop("slug"))


@query("o05_best_and_worst", CONTRIB + ", n as (select max(rank) n from k) select ticker, rank from k, n where rank <= 20 or rank > n - 6")
def _(tb):
    c = contributed(tb)
    return c.crossJoin(F.broadcast(c.agg(F.max("rank").alias("n")))).where("rank <= 20 or rank > n - 6").select("ticker", "rank")  # one row


PANEL = """
with ms as (select distinct month from prices), ts as (select distinct ticker from prices),
rt as (select a.ticker, a.month, case when not (a.price / b.price - 1 > 3 and b.price < 5) then a.price / b.price - 1 end r from prices a join prices b on a.ticker = b.ticker and b.month = cast(date_trunc('month', a.month) - interval '1' day as date)),
d as (select t.ticker, m.month, price, r from ts t cross join ms m left join prices p on p.ticker = t.ticker and p.month = m.month left join rt on rt.ticker = t.ticker and rt.month = m.month),
raw as (select ticker, month, price, lag(price, 1) over w / lag(price, 12) over w - 1 momentum, 1 - price / lag(price, 1) over w reversal,
  case when count(r) over (partition by ticker order by month rows between 11 preceding and current row) >= 2 then -stddev_samp(r) over (partition by ticker order by month rows between 11 preceding and current row) end low_vol, lead(r) over w fwd
  from d window w as (partition by ticker order by month)),
sig as (select * from raw where price is not null),
z as (select ticker, month, fwd,
  case when momentum is not null and count(momentum) over m >= 10 then least(greatest((momentum - avg(momentum) over m) / stddev_samp(momentum) over m, -3), 3) end momentum,
  case when reversal is not null and count(reversal) over m >= 10 then least(greatest((reversal - avg(reversal) over m) / stddev_samp(reversal) over m, -3), 3) end reversal,
  case when low_vol is not null and count(low_vol) over m >= 10 then least(greatest((low_vol - avg(low_vol) over m) / stddev_samp(low_vol) over m, -3), 3) end low_vol from sig window m as (partition by month))"""


def signals(tb):
    return g.price_signals(returns(tb), tb.prices, months(tb))


def panel(tb):
    return g.z_scores(signals(tb).select("ticker", "month", "fwd", *STYLES), STYLES)


@query("w13_price_signals", PANEL + " select ticker, month, round(momentum, 6) as momentum, round(reversal, 6) as reversal, round(low_vol, 6) as low_vol, round(fwd, 6) as fwd from sig")
def _(tb):
    return tidy(signals(tb).select("ticker", "month", *STYLES, "fwd"))


@query("k14_signal_panel", PANEL + " select ticker, month, round(momentum, 6) as momentum, round(reversal, 6) as reversal, round(low_vol, 6) as low_vol from z")
def _(tb):
    return tidy(panel(tb).select("ticker", "month", *STYLES))


@query("f10_robust_z", PANEL + " select month, count(momentum) as n, round(max(momentum), 6) as hi, round(min(momentum), 6) as lo from z group by month")
def _(tb):
    return tidy(panel(tb).groupBy("month").agg(F.count("momentum").alias("n"), F.max("momentum").alias("hi"), F.min("momentum").alias("lo")))


def _ic(signal):
    return PANEL + f""", ok as (select month, {signal} s, fwd from z where {signal} is not null and fwd is not null),
rk as (select month, rank() over (partition by month order by s) + (count(*) over (partition by month, s) - 1) / 2.0 a, rank() over (partition by month order by fwd) + (count(*) over (partition by month, fwd) - 1) / 2.0 b from ok),
ic as (select month, count(*) n, corr(a, b) ic from rk group by 1 having count(*) >= 10)"""


@query("r20_information_coefficients", _ic("momentum") + " select month, n, round(ic, 6) as ic from ic")
def _(tb):
    return tidy(r.information_coefficients(panel(tb), "momentum", "fwd", "month"))


@query("r20_ic_summary", _ic("reversal") + " select count(ic) as months, round(avg(ic), 6) as mean, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) as t, round(avg(case when ic > 0 then 1.0 else 0.0 end), 6) as positive from ic")
def _(tb):
    return tidy(r.ic_summary(r.information_coefficients(panel(tb), "reversal", "fwd", "month")))


@query("r27_univariate")
def _(tb):
    p = panel(tb)
    long = p.unpivot(["ticker", "month", "fwd"], STYLES, "signal", "value")
    return tidy(r.ic_summary(r.information_coefficients(long, "value", "fwd", "signal", "month"), "signal"))


@query("r21_decile_means", PANEL + """, ok as (select month, fwd, count(*) over (partition by month) n, row_number() over (partition by month order by low_vol, ticker) k from z where low_vol is not null and fwd is not null)
  select month, cast(greatest(1, ceil((k - 1) * 10 / (n - 1))) as int) as decile, round(avg(fwd), 6) as mean, count(*) as n from ok where n > 10 group by 1, 2""")
def _(tb):
    return tidy(r.decile_returns(panel(tb), "low_vol", "fwd"))


@query("k15_linear_composite")
def _(tb):
    return tidy(g.linear_composite(panel(tb), STYLES).select("ticker", "month", "composite"))


@query("a34_signal_correlations")
def _(tb):
    return tidy(g.signal_correlations(panel(tb), STYLES))


@query("o02_top_decile", PANEL + """, ok as (select month, ticker, count(*) over (partition by month) n, row_number() over (partition by month order by momentum desc, ticker) k from z where momentum is not null),
  kept as (select * from ok where k <= greatest(10, floor(n / 10))) select month, ticker, round(1.0 / count(*) over (partition by month), 6) as w from kept""")
def _(tb):
    return tidy(g.top_decile(panel(tb), "momentum"))


def model(tb):
    return g.cross_sections(panel(tb).join(tb.sectors, "ticker", "left"), STYLES)


@query("r10_cross_sections")
def _(tb):
    return tidy(model(tb))


@query("a42_average_r2")
def _(tb):
    return tidy(model(tb).where("factor = 'market'").groupBy(F.year("month").alias("year")).agg(F.avg("r2").alias("r2"), F.count("*").alias("months")))


@query("r33_factor_volatility")
def _(tb):
    return tidy(model(tb).groupBy("factor").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.try_divide(F.avg("ret"), F.stddev_samp("ret") / F.sqrt(F.count("*"))).alias("t")))


FACTOR_LONG = "fl as (select month, 'smb' factor, smb ret from factors union all select month, 'hml', hml from factors union all select month, 'mkt_rf', mkt_rf from factors)"


@query("r11_factor_covariance", f"""with {FACTOR_LONG},
p as (select * from fl where month < date '2001-01-31'), a as (select month, row_number() over (order by month desc) - 1 age from (select distinct month from p)), w as (select month, pow(0.5, age / 24.0) w from a where age < 60),
x as (select p.month, factor, ret, w from p join w on p.month = w.month), m as (select factor, sum(w * ret) / sum(w) m from x group by 1), d as (select x.month, x.factor, w, ret - m d from x join m on x.factor = m.factor)
select a.factor as i, b.factor as j, round(sum(a.w * a.d * b.d) / sum(a.w), 6) as v from d a join d b on a.month = b.month group by 1, 2""")
def _(tb):
    return tidy(g.factor_covariance(tb.factors.unpivot(["month"], ["smb", "hml", "mkt_rf"], "factor", "ret"), "2001-01-31"))


@query("w19_ewma_weights", "with aged as (select month, row_number() over (order by month desc) k from factors), weighed as (select month, pow(0.5, (k - 1) / 24.0) x from aged where k <= 60) select month, round(x / (select sum(x) from weighed), 6) as w from weighed")
def _(tb):
    return tidy(g.ewma_weights(tb.factors.select("month")))


@query("r12_specific_variance")
def specific(tb):
    u = returns(tb).join(F.broadcast(tb.factors.select("month", "mkt_rf")), "month").select("ticker", "month", (F.col("r") - F.col("mkt_rf")).alias("u"))  # a row for each month
    return tidy(g.specific_variance(u, "2001-01-31"))


@query("r13_risk_split")
def _(tb):
    cov = g.factor_covariance(model(tb).select("month", "factor", "ret"), "2001-01-31")
    last = panel(tb).where("month = date '2000-12-31'")
    styles = last.unpivot(["ticker"], STYLES, "factor", "x").where("x is not null")
    ones = last.select("ticker", F.lit("market").alias("factor"), F.lit(1.0).alias("x"))
    inds = tb.sectors.select("ticker", F.concat(F.lit("ind:"), "sector").alias("factor"), F.lit(1.0).alias("x"))
    w = weights(tb).where("formation = date '2000-11-30'").select("portfolio", "ticker", "w")
    return tidy(g.decompose(w, styles.unionByName(ones).unionByName(inds), cov, specific(tb)))


AUDIT = LONG + BOOK + """, best as (select formation, ticker, count(*) k from books where ticker is not null and rank <= 3 group by 1, 2), t as (select formation, ticker, k / sum(k) over (partition by formation) w from best),
act as (select coalesce(t.formation, b.formation) formation, coalesce(t.ticker, b.ticker) ticker, t.w, b.w b, coalesce(t.w, 0) - coalesce(b.w, 0) a from t full outer join wt b on t.formation = b.formation and t.ticker = b.ticker)"""


def best3(tb):
    return weights(tb).where("portfolio = 'BEST3'").select("formation", "ticker", "w")


@query("k17_weights_audit", AUDIT + """ select formation, round(sum(w), 6) as total, count(*) filter (where w > 0.02) as over_cap, count(*) filter (where abs(a) > 0.01) as off_band, round(sum(abs(a)) / 2, 6) as active_share,
  count(*) filter (where b is null and w > 0) as outside from act group by formation""")
def _(tb):
    return tidy(g.audit_weights(best3(tb), whole(tb).select("formation", "ticker", "w"), tb.sectors, cap=0.02, band=0.01).select("formation", "total", "over_cap", "off_band", "active_share", "outside"))


@query("k26_sector_exposure", AUDIT + """ select formation, sector, round(sum(coalesce(w, 0)), 6) as portfolio, round(sum(coalesce(b, 0)), 6) as benchmark, round(sum(a), 6) as active from act join sectors s on act.ticker = s.ticker group by 1, 2""")
def _(tb):
    return tidy(g.sector_exposure(best3(tb), whole(tb).select("formation", "ticker", "w"), tb.sectors))


@query("k18_trade_list", AUDIT + """, n as (select ticker, w from t where formation = date '2000-11-30'), o as (select ticker, w from t where formation = date '2000-08-31'),
  c as (select coalesce(n.ticker, o.ticker) ticker, (coalesce(n.w, 0) - coalesce(o.w, 0)) * 1000000 dollars from n full outer join o on n.ticker = o.ticker)
  select c.ticker as ticker, round(dollars, 2) as dollars, round(dollars / price, 6) as shares, case when dollars > 0 then 'buy' else 'sell' end as side, round(abs(dollars) * 0.001, 6) as cost
  from c left join prices p on p.ticker = c.ticker and p.month = date '2000-11-30' where dollars <> 0""")
def _(tb):
    t = best3(tb)
    at = lambda d: t.where(F.col("formation") == F.lit(d).cast("date")).select("ticker", "w")
    return tidy(g.trade_list(at("2000-11-30"), at("2000-08-31"), tb.prices.where("month = date '2000-11-30'"), 1_000_000.0), ("dollars",))


@query("k19_backtest_summary")
def _(tb):
    p = g.portfolio_returns(weights(tb), returns(tb), months(tb), "portfolio", least=3)
    return tidy(g.backtest_summary(p, tb.factors.select("month", (F.col("mkt_rf") + F.col("rf")).alias("r")), "portfolio"))


@query("r30_cost_sensitivity")
def _(tb):
    w, rt, ms = weights(tb), returns(tb), months(tb)
    return tidy(g.cost_sensitivity(g.portfolio_returns(w, rt, ms, "portfolio", least=3), g.turnover(w, rt, ms, "portfolio"), [0.0, 0.0005, 0.001, 0.002, 0.005, 0.02], "portfolio"))


@query("a29_capacity")
def _(tb):
    volume = tb.lineitem.join(tb.cusip_map, F.col("l_partkey") == F.col("cusip")).groupBy("ticker").agg((F.sum("l_extendedprice") / 252).alias("volume"))
    return tidy(g.capacity(best3(tb).where("formation = date '2000-11-30'"), volume, [1e5, 3e5, 1e6, 3e6, 1e7, 3e7, 1e8]))


FEATURES = """
with w as (select slug, month, count(*) over b nb, product(1 + r_p) over b - product(1 + r_b) over b e, stddev_samp(r_p) over b v, count(*) over a na, product(1 + r_p) over a - product(1 + r_b) over a f
  from aligned window b as (partition by slug order by month rows between 11 preceding and current row), a as (partition by slug order by month rows between 1 following and 12 following)),
x as (select slug, month, case when nb = 12 then e end excess12, case when nb = 12 then v end vol12, case when na = 12 then f end fwd_excess from w)"""


@query("w07_trailing_features", FEATURES + " select slug, month, round(excess12, 6) as excess12, round(vol12, 6) as vol12, round(fwd_excess, 6) as fwd_excess from x")
def _(tb):
    return tidy(g.trailing_features(tb.aligned).select("slug", "month", "excess12", "vol12", "fwd_excess"))


@query("w07_trailing_drawdown")
def _(tb):
    return tidy(g.trailing_features(tb.aligned).select("slug", "month", "drawdown12"))


def labelled(tb):
    return g.trailing_features(tb.aligned).withColumn("y", (F.col("fwd_excess") > F.col("excess12")).cast("int"))


@query("r24_auc", FEATURES + """, ok as (select case when fwd_excess > excess12 then 1 else 0 end y, excess12 s from x where fwd_excess is not null and excess12 is not null),
  k as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 rk from ok) select count(*) as n, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) as auc from k""")
def _(tb):
    return tidy(r.auc_pooled(labelled(tb), "y", "excess12"))


@query("r24_auc_by_month", FEATURES + """, ok as (select month, case when fwd_excess > excess12 then 1 else 0 end y, excess12 s from x where fwd_excess is not null and excess12 is not null),
  k as (select month, y, rank() over (partition by month order by s) + (count(*) over (partition by month, s) - 1) / 2.0 rk from ok)
  select month, count(*) as n, round(case when sum(y) * sum(1 - y) > 0 then (sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) end, 6) as auc from k group by month""")
def _(tb):
    return tidy(r.auc(labelled(tb), "y", "excess12", "month"))


@query("o03_extremes", FEATURES + """, k as (select *, row_number() over (partition by month order by excess12 desc, slug) hi, row_number() over (partition by month order by excess12, slug) lo from x where excess12 is not null and fwd_excess is not null)
  select month, round(avg(case when hi <= 10 then fwd_excess end), 6) as high, round(avg(case when lo <= 10 then fwd_excess end), 6) as low from k group by month""")
def _(tb):
    return tidy(g.extremes(g.trailing_features(tb.aligned), "excess12", "fwd_excess", 10))


@query("r26_brier", FEATURES + """, ok as (select case when fwd_excess > excess12 then 1 else 0 end y, case when excess12 > 0 then 0.7 else 0.3 end p from x where fwd_excess is not null and excess12 is not null)
  select count(*) as n, round(avg(pow(p - y, 2)), 6) as brier, round(avg(pow((select avg(y) from ok) - y, 2)), 6) as base, round(1 - avg(pow(p - y, 2)) / avg(pow((select avg(y) from ok) - y, 2)), 6) as skill from ok""")
def _(tb):
    ok = labelled(tb).where("fwd_excess is not null and excess12 is not null").withColumn("p", F.when(F.col("excess12") > 0, 0.7).otherwise(0.3))
    return tidy(r.brier(ok, "y", "p"))


@query("j18_features_with_returns", LONG + """, n as (select slug, formation, count(*) n from books group by 1, 2) select n.slug as slug, n.formation as formation, n, round(m.r, 6) as r from n left join manager_returns m on n.slug = m.slug and n.formation = m.month""")
def _(tb):
    n = books(tb).groupBy("slug", "formation").agg(F.count("*").alias("n"))
    return tidy(n.join(tb.manager_returns.withColumnRenamed("month", "formation"), ["slug", "formation"], "left"))


ASOF = """
with f as (select distinct concat(p_brand, '/', p_type) ticker, cast(o_orderdate as date) filed, cast(cast(o_orderdate as date) - cast(o_orderkey % 400 as int) as date) "end", o_totalprice as value
  from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey where p_partkey % 20 <> 0),
g as (select ticker, filed, "end", max(value) as value from f group by 1, 2, 3)"""


@query("j14_as_of", ASOF + """, c as (select p.ticker, p.month, g.value, g."end", row_number() over (partition by p.ticker, p.month order by filed desc, "end" desc) k from prices p join g on g.ticker = p.ticker and g.filed <= p.month and date_diff('day', g."end", p.month) <= 456)
  select p.ticker as ticker, p.month as t, round(c.value, 2) as value from prices p left join c on p.ticker = c.ticker and p.month = c.month and k = 1""")
def _(tb):
    o = tb.orders.join(tb.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(tb.part.where("p_partkey % 20 <> 0"), F.col("l_partkey") == F.col("p_partkey"))
    f = o.select(F.concat("p_brand", F.lit("/"), "p_type").alias("ticker"), F.to_date("o_orderdate").alias("filed"), F.date_sub(F.to_date("o_orderdate"), (F.col("o_orderkey") % 400).cast("int")).alias("end"), F.col("o_totalprice").alias("value"))
    return tidy(g.as_of(tb.kept("prices").select("ticker", F.col("month").alias("t")), f).select("ticker", "t", "value"), ("value",))


@query("w12_clean_share_counts")
def _(tb):
    filed = tb.holdings.groupBy(F.col("slug").alias("ticker"), F.col("period").alias("end")).agg(F.sum("shares").alias("value"))
    off = F.when((F.col("ticker") % 9 == 0) & (F.month("end") == 9), F.col("value") * 1000).when((F.col("ticker") % 5 == 0) & (F.year("end") < 1998), F.col("value") / 4).otherwise(F.col("value"))
    return tidy(g.clean_shares(filed.withColumn("value", off)))


@query("f12_split_ratio", "select distinct cast(l_linenumber as double) as jump, case when l_linenumber in (2, 3, 4, 5, 6, 7, 8, 10, 15, 20, 25, 30, 50) then cast(l_linenumber as double) else 1.0::double end as ratio from lineitem")
def _(tb):
    from ..functions.columns import split_ratio

    return tb.lineitem.select(F.col("l_linenumber").cast("double").alias("jump")).distinct().withColumn("ratio", split_ratio(F.col("jump")))


SHARES = """
sf as (select ticker, ends, filed, value from facts where fact = 'shares' and start is null and value > 0 and form in ('10-K', '10-Q', '10-K/A', '10-Q/A') qualify row_number() over (partition by ticker, ends order by filed desc, value desc) = 1),
sl as (select *, ln(value) lv, list_concat(coalesce(list(ln(value)) over (partition by ticker order by ends rows between 4 preceding and 1 preceding), []), coalesce(list(ln(value)) over (partition by ticker order by ends rows between 1 following and 4 following), [])) near from sf),
sb as (select *, coalesce(len(near) >= 2 and abs(lv - list_median(near)) >= ln(5), false) bad from sl),
sg as (select *, sum(case when was is null or bad <> was then 1 else 0 end) over (partition by ticker order by ends) run from (select *, lag(bad) over (partition by ticker order by ends) was from sb) y),
sk as (select ticker, ends, filed, value from (select *, count(*) over (partition by ticker, run) long from sg) y where not (bad and long <= 3)),
sj as (select *, lead(value) over (partition by ticker order by ends) / value jump from sk),
sr as (select *, coalesce([case when abs(jump / k - 1) <= 0.04 then k else 1 / k end for k in [1.5, 2, 3, 4, 5, 6, 7, 8, 10, 15, 20, 25, 30, 50]::double[] if abs(jump / k - 1) <= 0.04 or abs(jump * k - 1) <= 0.04][1], 1.0) ratio from sj),
sa as (select ticker, ends, filed, value * product(ratio) over (partition by ticker order by ends rows between current row and unbounded following) v from sr),
sm as (select ticker, ends, filed, v from (select *, median(v) over (partition by ticker) mid from sa) y where v <= 20 * mid and v >= mid / 20)"""
FUNDAMENTALS = SHARES + """,
ff as (select ticker, fact, filed, ends, value from facts where (fact in ('equity', 'assets') and start is null) or (fact in ('net_income', 'op_cf') and date_diff('day', start, ends) between 330 and 400) union all select ticker, 'shares', filed, ends, v from sm),
fk as (select p.ticker, p.month, f.fact, f.value from prices p join ff f on f.ticker = p.ticker and f.filed <= p.month and date_diff('day', f.ends, p.month) <= 456 qualify row_number() over (partition by p.ticker, p.month, f.fact order by f.filed desc, f.ends desc, f.value desc) = 1),
fp as (select ticker, month, max(case when fact = 'equity' then value end) eq, max(case when fact = 'assets' then value end) at_, max(case when fact = 'shares' then value end) sh, max(case when fact = 'net_income' then value end) ni, max(case when fact = 'op_cf' then value end) cf from fk group by 1, 2),
fc as (select p.ticker, p.month, eq, at_, ni, cf, sh * price cap from prices p left join fp on fp.ticker = p.ticker and fp.month = p.month),
fs as (select ticker, month, case when cap > 0 then -ln(cap) end size, case when eq > 0 and cap > 0 then eq / cap end value, case when at_ > 0 then ni / at_ end profitability, case when at_ > 0 then cf / at_ end cash_flow, case when cap > 0 then ni / cap end earnings_yield from fc)"""


def facts(tb):
    return tb.facts.withColumnRenamed("ends", "end")


def fundamentals(tb):
    return g.fundamental_signals(tb.prices.select("ticker", "month", F.col("price").alias("close")), facts(tb))


@query("w12_usable_shares", "with " + SHARES.strip() + " select ticker, ends, filed, round(v, 6) as value from sm")
def _(tb):
    return tidy(g.usable_shares(facts(tb).where("fact = 'shares'")).withColumnRenamed("end", "ends"))


@query("k14_fundamental_signals", "with " + FUNDAMENTALS.strip() + " select ticker, month, " + ", ".join(f"round({x}, 6) as {x}" for x in g.FUNDAMENTAL) + " from fs")
def _(tb):
    return tidy(fundamentals(tb))


def eight(tb):
    """The panel of all eight signals, scored by month."""
    return g.z_scores(signals(tb).select("ticker", "month", "fwd", *STYLES).join(fundamentals(tb), ["ticker", "month"], "left"), [*STYLES, *g.FUNDAMENTAL])


@query("k14_eight_signals", PANEL + ", " + FUNDAMENTALS.strip() + " select z.ticker as ticker, z.month as month, round(z.momentum, 6) as momentum, " + ", ".join(
    f"round(case when fs.{x} is not null and count(fs.{x}) over m >= 10 then least(greatest((fs.{x} - avg(fs.{x}) over m) / nullif(stddev_samp(fs.{x}) over m, 0), -3), 3) end, 6) as {x}" for x in g.FUNDAMENTAL
) + " from z left join fs on fs.ticker = z.ticker and fs.month = z.month window m as (partition by z.month)")
def _(tb):
    return tidy(eight(tb).select("ticker", "month", "momentum", *g.FUNDAMENTAL))


@query("r27_eight_univariate")
def _(tb):
    every = [*STYLES, *g.FUNDAMENTAL]
    long = eight(tb).unpivot(["ticker", "month", "fwd"], every, "signal", "value")
    return tidy(r.ic_summary(r.information_coefficients(long, "value", "fwd", "signal", "month"), "signal"))


@query("k15_eight_composite")
def _(tb):
    return tidy(g.linear_composite(eight(tb), [*STYLES, *g.FUNDAMENTAL]).select("ticker", "month", "composite"))


DRAWS = PANEL + """, scored as (select z.month, z.ticker from z join sectors s on z.ticker = s.ticker where fwd is not null and momentum is not null and reversal is not null and low_vol is not null),
  enough as (select month from scored group by 1 having count(*) >= 100), every as (select f.month, f.ticker, d.draw from scored f join enough e on f.month = e.month cross join range(0, 100) d(draw)),
  drawn as (select month, draw, ticker, row_number() over (partition by month, draw order by md5(concat_ws('|', '0', cast(month as varchar), cast(draw as varchar), ticker)), ticker) k from every)"""


@query("r14_random_portfolios", DRAWS + " select month, cast(draw as int) as draw, count(*) as names, min(ticker) as first, max(ticker) as last from drawn where k <= 50 group by 1, 2")
def _(tb):
    names = panel(tb).join(tb.sectors, "ticker").select("month", "ticker", "sector", "fwd", *STYLES).dropna().select("month", "ticker")
    return t.random_portfolios(names).groupBy("month", "draw").agg(F.count("*").alias("names"), F.min("ticker").alias("first"), F.max("ticker").alias("last"))


@query("r14_bias_statistic")
def _(tb):
    return tidy(t.bias_statistic(panel(tb).join(tb.sectors, "ticker"), STYLES))


def signal_backtest(tb):
    bench = t.aggregate_book(books(tb), tb.prices, least=2)
    return t.signal_backtest(bench, signals(tb).select("month", "ticker", F.col("momentum").alias("s")), returns(tb), months(tb))


BACKTEST = LONG + ", " + PANEL.strip().removeprefix("with ") + """,
k0 as (select formation, ticker, sum(value) v from books where ticker is not null group by 1, 2 having count(distinct slug) >= 2),
k1 as (select h.formation, h.ticker, v / sum(v) over (partition by h.formation) w from k0 h join prices p on h.ticker = p.ticker and h.formation = p.month where p.price >= 1),
k2 as (select b.formation, b.ticker, b.w, s.momentum s, count(*) over (partition by b.formation) n from k1 b join sig s on s.ticker = b.ticker and s.month = b.formation where s.momentum is not null),
uni as (select *, w / sum(w) over (partition by formation) b, row_number() over (partition by formation order by s desc, ticker) k from k2 where n >= 30),
best as (select formation, ticker, 1.0 / count(*) over (partition by formation) w from uni where k <= greatest(10, floor(n / 10))),
goal as (select 'portfolio' kind, formation, ticker, w from best union all select 'benchmark', formation, ticker, b from uni),
fm as (select kind, formation, lead(formation) over (partition by kind order by formation) until from (select distinct kind, formation from goal) q),
sp as (select kind, formation, month from fm join ms on month > formation and (until is null or month <= until)),
gr as (select t.kind, t.formation, t.ticker, sp.month, t.w, rt.r from goal t join sp on sp.kind = t.kind and sp.formation = t.formation left join rt on rt.ticker = t.ticker and rt.month = sp.month),
lv as (select *, w * coalesce(product(1 + r) over (partition by kind, formation, ticker order by month rows between unbounded preceding and 1 preceding), 1) g, max(case when r is null then 1 else 0 end) over (partition by kind, formation, ticker order by month) lost from gr),
dr as (select *, g / sum(g) over (partition by kind, month) weight from lv where lost = 0),
en as (select *, max(month) over (partition by kind, formation) final from dr),
ol as (select f.until formation, e.ticker, weight * (1 + r) / sum(weight * (1 + r)) over (partition by e.formation) old from en e join fm f on f.kind = e.kind and f.formation = e.formation where e.kind = 'portfolio' and month = final and f.until is not null),
tu as (select coalesce(t.formation, o.formation) formation, count(t.w) names, case when count(old) > 0 then sum(abs(coalesce(t.w, 0) - coalesce(old, 0))) / 2 else 1.0 end turnover from best t full join ol o on t.formation = o.formation and t.ticker = o.ticker group by 1)"""


MONTHLY = """, mo as (select kind, formation, month, sum(weight * r) r, count(*) names from dr group by 1, 2, 3),
pf as (select month, r - case when month = min(month) over (partition by mo.formation) then 0.002 * turnover else 0 end r, mo.names from mo join tu on tu.formation = mo.formation where kind = 'portfolio')"""


@query("k20_signal_backtest", BACKTEST + MONTHLY + """
select coalesce(p.month, q.month) as month, round(p.r, 6) as portfolio, round(q.r, 6) as benchmark, p.names as names from pf p full join (select month, r from mo where kind = 'benchmark') q on p.month = q.month""")
def _(tb):
    return tidy(signal_backtest(tb)[0])


@query("k20_aggregate_book", LONG + """, held as (select formation, ticker, count(distinct slug) n, sum(value) v from books where ticker is not null group by 1, 2 having count(distinct slug) >= 2),
  ok as (select h.* from held h join prices p on h.ticker = p.ticker and h.formation = p.month where p.price >= 1) select formation, ticker, round(v / sum(v) over (partition by formation), 6) as w from ok""")
def _(tb):
    return tidy(t.aggregate_book(books(tb), tb.prices, least=2))


LOG = """, ac as (select u.formation, max(n) universe, sum(abs(coalesce(p.w, 0) - u.b)) / 2 active_share, corr(coalesce(p.w, 0) - u.b, s) transfer from uni u left join best p on p.formation = u.formation and p.ticker = u.ticker group by 1),
ah as (select u.formation, u.ticker, s, product(1 + rt.r) - 1 f from uni u join sp on sp.formation = u.formation and sp.kind = 'benchmark' join rt on rt.ticker = u.ticker and rt.month = sp.month where rt.r is not null group by 1, 2, 3),
rk as (select formation, rank() over (partition by formation order by s) + (count(*) over (partition by formation, s) - 1) / 2.0 a, rank() over (partition by formation order by f) + (count(*) over (partition by formation, f) - 1) / 2.0 b from ah),
ri as (select formation, case when count(*) >= 30 then corr(a, b) end ic from rk group by 1)"""


@query("k27_rebalance_log", BACKTEST + LOG + """
select tu.formation as formation, universe, names, round(turnover, 6) as turnover, round(0.002 * turnover, 6) as drag, round(active_share, 6) as active_share, round(transfer, 6) as transfer, round(ic, 6) as realized_ic from tu join ac on ac.formation = tu.formation left join ri on ri.formation = tu.formation""")
def _(tb):
    return tidy(signal_backtest(tb)[1])


@query("r29_fundamental_law", BACKTEST + MONTHLY + LOG + """,
lg as (select universe, transfer, ic from tu join ac on ac.formation = tu.formation left join ri on ri.formation = tu.formation),
il as (select avg(ic) ic, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) ic_t, avg(transfer) transfer, avg(universe) * 4 breadth from lg),
ra as (select count(*) / 12.0 yrs, avg(p.r - q.r) / stddev_samp(p.r - q.r) * sqrt(12) ir from pf p join mo q on p.month = q.month and q.kind = 'benchmark' where p.r is not null and q.r is not null)
select round(ic, 6) as ic, round(ic_t, 6) as ic_t, round(transfer, 6) as transfer, round(breadth, 6) as breadth, round(transfer * ic * sqrt(breadth), 6) as ir_implied, round(ir, 6) as ir_actual, round(yrs, 6) as "years",
  round(sqrt((1 + ir * ir / 2) / yrs), 6) as ir_se, round(ir * sqrt(yrs), 6) as ir_t from il, ra""")
def _(tb):
    return tidy(t.fundamental_law(*signal_backtest(tb)))
