"""Queries on return records: risk, regressions, resampling, scores, leaderboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import risk as r
from .registry import query, tidy

METRICS = """
with base as (select slug, count(*) periods, pow(product(1 + r_p), 12.0 / count(*)) - 1 ann_p, pow(product(1 + r_b), 12.0 / count(*)) - 1 ann_b, stddev_samp(r_p) * sqrt(12) vol_p, stddev_samp(r_b) * sqrt(12) vol_b,
  avg(y) / stddev_samp(y) * sqrt(12) sharpe_p, avg(y_b) / stddev_samp(y_b) * sqrt(12) sharpe_b, avg(y) / sqrt(avg(pow(least(y, 0), 2))) * sqrt(12) sortino_p, stddev_samp(r_p - r_b) * sqrt(12) tracking_error,
  avg(r_p - r_b) / stddev_samp(r_p - r_b) * sqrt(12) information_ratio, covar_samp(y, y_b) / var_samp(y_b) beta, corr(r_p, r_b) correlation,
  (pow(product(case when r_b > 0 then 1 + r_p else 1 end), 1.0 / count(*) filter (where r_b > 0)) - 1) / (pow(product(case when r_b > 0 then 1 + r_b else 1 end), 1.0 / count(*) filter (where r_b > 0)) - 1) up_capture,
  (pow(product(case when r_b <= 0 then 1 + r_p else 1 end), 1.0 / count(*) filter (where r_b <= 0)) - 1) / (pow(product(case when r_b <= 0 then 1 + r_b else 1 end), 1.0 / count(*) filter (where r_b <= 0)) - 1) down_capture,
  min(r_p) worst_p from aligned group by 1),
idx as (select slug, month, exp(sum(ln(1 + r_p)) over (partition by slug order by month)) i from aligned),
dd as (select slug, month, i, max(i) over (partition by slug order by month) peak, i / max(i) over (partition by slug order by month) - 1 d from idx),
mdd as (select slug, min(d) max_drawdown_p from dd group by 1)"""


@query("a17_risk_metrics", METRICS + """ select b.slug as slug, periods, round(ann_p, 6) as ann_p, round(ann_b, 6) as ann_b, round(vol_p, 6) as vol_p, round(vol_b, 6) as vol_b, round(sharpe_p, 6) as sharpe_p, round(sharpe_b, 6) as sharpe_b,
  round(sortino_p, 6) as sortino_p, round(tracking_error, 6) as tracking_error, round(information_ratio, 6) as information_ratio, round(beta, 6) as beta, round(correlation, 6) as correlation, round(up_capture, 6) as up_capture,
  round(down_capture, 6) as down_capture, round(worst_p, 6) as worst_p, round(max_drawdown_p, 6) as max_drawdown_p, round(case when max_drawdown_p < 0 then ann_p / abs(max_drawdown_p) end, 6) as calmar_p from base b join mdd m on b.slug = m.slug""")
def _(tb):
    keep = ["slug", "periods", "ann_p", "ann_b", "vol_p", "vol_b", "sharpe_p", "sharpe_b", "sortino_p", "tracking_error", "information_ratio", "beta", "correlation", "up_capture", "down_capture", "worst_p", "max_drawdown_p", "calmar_p"]
    return tidy(r.risk_metrics(tb.aligned, "slug").select(*keep))


@query("a18_tail_risk", """
with c as (select slug, count(r_p) n, quantile_cont(r_p, 0.05) var_hist, avg(r_p) - 1.6448536269514722 * stddev_samp(r_p) var_param from aligned group by 1)
select c.slug as slug, n, round(var_hist, 6) as var_hist, round(var_param, 6) as var_param, round(avg(case when r_p <= var_hist + 1e-15 then r_p end), 6) as shortfall from aligned a join c on a.slug = c.slug group by 1, 2, c.var_hist, c.var_param""")
def _(tb):
    return tidy(r.tail_risk(tb.aligned, "slug"))


@query("a19_risk_by_year", """
with w as (select *, year(month) yr, count(r_p) over t nb, stddev_samp(r_p) over t sdb, quantile_cont(r_p, 0.05) over t vb from aligned window t as (partition by slug order by month rows between 35 preceding and current row))
select slug, cast(yr as int) as year, count(*) as n, round(product(1 + r_p) - 1, 6) as return_p, round(product(1 + r_b) - 1, 6) as return_b, round(case when count(*) >= 3 then stddev_samp(r_p) * sqrt(12) end, 6) as vol_p,
  round(case when count(*) >= 3 then quantile_cont(r_p, 0.05) end, 6) as var95_p, round(case when count(*) >= 3 then min(r_p) end, 6) as worst_p,
  round(arg_max(sdb, month) filter (where nb >= 18) * sqrt(12), 6) as trailing_vol_p, round(arg_max(vb, month) filter (where nb >= 18), 6) as trailing_var95_p from w group by 1, 2""")
def _(tb):
    return tidy(r.risk_by_year(tb.aligned, "slug"))


@query("a20_risk_return_points", """
with l as (select slug, 'account' kind, r_p r from aligned union all select slug, 'benchmark', r_b from aligned union all select slug, 'rf', rf from aligned)
select slug, kind, count(*) as n, round(pow(product(1 + r), 12.0 / count(*)) - 1, 6) as ret, round(stddev_samp(r) * sqrt(12), 6) as vol from l group by 1, 2 having count(*) >= 3""")
def _(tb):
    return tidy(r.risk_return_points(tb.aligned))


@query("w08_drawdowns", METRICS + " select slug, month, round(d, 6) as drawdown from dd")
def _(tb):
    return tidy(r.drawdowns(tb.aligned, "r_p", "slug").select("slug", "month", "drawdown"))


@query("w09_drawdown_episode", METRICS + """,
low as (select slug, month trough, d depth, peak high from (select *, row_number() over (partition by slug order by d, month) k from dd) where k = 1)
select l.slug as slug, trough, round(depth, 6) as depth, max(case when month <= trough and d = 0 then month end) as peak, min(case when month > trough and i >= high then month end) as recovery
from low l join dd on dd.slug = l.slug group by l.slug, trough, depth""")
def _(tb):
    return tidy(r.drawdown_episode(tb.aligned, "r_p", "slug"))


@query("w10_rolling_excess", """
with w as (select slug, month, count(*) over t n, product(1 + r_p) over t - product(1 + r_b) over t excess from aligned window t as (partition by slug order by month rows between 35 preceding and current row))
select slug, month, round(excess, 6) as excess from w where n = 36""")
def _(tb):
    return tidy(r.rolling_excess(tb.aligned, 36))


@query("w10_rolling_capm", """
with w as (select slug, month, count(*) over t n, regr_slope(y, y_b) over t beta, regr_intercept(y, y_b) over t alpha from aligned window t as (partition by slug order by month rows between 59 preceding and current row))
select slug, month, round(alpha, 6) as alpha, round(beta, 6) as beta from w where n = 60""")
def _(tb):
    return tidy(r.rolling_capm(tb.aligned, 60).select("slug", "month", "alpha", "beta"))


@query("r01_capm_closed_form", "select slug, count(*) as n, round(regr_slope(y, y_b), 6) as beta, round(regr_intercept(y, y_b), 6) as alpha, round(regr_r2(y, y_b), 6) as r2 from aligned group by 1")
def _(tb):
    return tidy(r.capm(tb.aligned).select("slug", "n", "beta", "alpha", "r2"))


@query("r04_beta_decomposition", "select slug, round(avg(rf), 6) as rf, round(regr_slope(y, y_b) * avg(y_b), 6) as from_market, round(avg(r_p) - avg(rf) - regr_slope(y, y_b) * avg(y_b), 6) as rest from aligned group by 1")
def _(tb):
    return tidy(r.capm(tb.aligned).select("slug", "rf", "from_market", "rest"))


@query("j08_factor_alignment", "select slug, m.month as month, round(m.r, 6) as r_p, round(f.mkt_rf, 6) as mkt_rf, round(f.smb, 6) as smb from manager_returns m left join factors f on m.month = f.month")
def _(tb):
    return tidy(tb.manager_returns.join(F.broadcast(tb.factors.select("month", "mkt_rf", "smb")), "month", "left").select("slug", "month", F.col("r").alias("r_p"), "mkt_rf", "smb"))  # a row for each month


@query("r01_factor_regressions")
def _(tb):
    return tidy(r.factor_regressions(tb.aligned).select("slug", "model", "n", "alpha", "se", "t", "p", "r2", "adj_r2", "resid_sd"))


@query("r03_timing_tests")
def _(tb):
    return tidy(r.timing_tests(tb.aligned))


@query("r07_subperiods")
def _(tb):
    return tidy(r.subperiods(tb.aligned, "1998-06-30"))


@query("r32_rolling_ff3")
def _(tb):
    return tidy(r.rolling_ff3(tb.aligned))


@query("r34_residuals")
def _(tb):
    return tidy(r.residuals(tb.aligned))


@query("r16_shrunk_alphas")
def _(tb):
    return tidy(r.shrink_alphas(r.residuals(tb.aligned).groupBy("slug").agg(F.first("alpha").alias("alpha"), F.first("se").alias("se"))))


@query("r17_pair_correlations", """
with p as (select a.slug a, b.slug b, count(*) n, corr(a.r, b.r) c from manager_returns a join manager_returns b on a.month = b.month and a.slug < b.slug group by 1, 2)
select a, b, n, round(c, 6) as corr, round(c / 2, 6) as shrunk from p where n >= 24""")
def _(tb):
    tb.kept("manager_values")
    return tidy(r.pair_correlations(tb.manager_returns, "r"))


@query("r25_hac_mean", """
with s as (select month, mkt_rf - avg(mkt_rf) over () u, avg(mkt_rf) over () m, count(*) over () n from factors), l as (select *, lag(u, 1) over (order by month) a, lag(u, 2) over (order by month) b, lag(u, 3) over (order by month) c from s)
select round(max(m), 6) as mean, max(n) as n, round(max(m) / (sqrt(sum(u * u) + 1.5 * sum(u * a) + 1.0 * sum(u * b) + 0.5 * sum(u * c)) / max(n)), 6) as t from l""")
def _(tb):
    return tidy(r.hac_mean(tb.factors.select("month", "mkt_rf"), "mkt_rf"))


@query("b01_bootstrap")
def _(tb):
    return tidy(r.bootstrap(tb.aligned))


@query("b02_null_cohort")
def _(tb):
    return tidy(r.null_cohort(tb.aligned))


@query("a40_null_histogram")
def _(tb):
    b = r.null_cohort(tb.aligned)
    return b.select(F.width_bucket("percentile", F.lit(0.0), F.lit(1.0), F.lit(48)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def _board(tb):
    m, fits = r.risk_metrics(tb.kept("aligned"), "slug"), r.factor_regressions(tb.aligned)
    return m, fits


@query("r09_skill")
def _(tb):
    return tidy(r.skill(*_board(tb)))


@query("k01_scores")
def _(tb):
    m, fits = _board(tb)
    tails = r.tail_risk(tb.aligned, "slug").select("slug", F.col("shortfall").alias("es_p"))
    bench = r.tail_risk(tb.aligned.withColumn("r_p", F.col("r_b")), "slug").select("slug", F.col("shortfall").alias("es_b"))
    share = r.rolling_excess(tb.aligned, 60).groupBy("slug").agg(F.avg((F.col("excess") > 0).cast("double")).alias("share_positive"))
    return tidy(r.scores(m, tails.join(bench, "slug"), fits, share))


@query("a35_leaderboard")
def leaderboard(tb):
    m, fits = _board(tb)
    head = fits.where("model = 'FF3'").select("slug", "t", "p", (F.col("alpha") * 12).alias("alpha"))
    luck = r.null_cohort(tb.aligned).select("slug", "percentile")
    boot = r.bootstrap(tb.aligned).select("slug", "p_one_sided")
    rows = m.select("slug", "periods", "ann_p", "vol_p", "sharpe_p").join(head, "slug").join(luck, "slug").join(boot, "slug").join(tb.funds.select("slug", "manager", "style"), "slug")
    return tidy(rows.withColumn("verdict", r.verdict(F.col("t"), F.col("p_one_sided"), F.col("percentile"))))


@query("p17_verdicts")
def _(tb):
    return leaderboard(tb).groupBy("verdict").agg(F.count("*").alias("n"))


@query("p16_screen", "select slug, manager, style, count(*) as months from aligned a join funds f using (slug) where style in ('ls', 'conc', 'lo') group by 1, 2, 3 having count(*) >= 36 order by months desc, slug")
def _(tb):
    m = tb.aligned.groupBy("slug").agg(F.count("*").alias("months")).where("months >= 36")
    return m.join(tb.funds.where("style in ('ls', 'conc', 'lo')"), "slug").select("slug", "manager", "style", "months").orderBy(F.desc("months"), "slug")


@query("j20_table_diff")
def _(tb):
    closed = r.capm(tb.aligned).select("slug", "alpha", F.col("beta"))
    grouped = r.factor_regressions(tb.aligned, {"CAPM": ["mkt_rf"]}).select("slug", "alpha", F.element_at("betas", 1).alias("beta"))
    return tidy(r.table_diff(closed, grouped, ["slug"], ["alpha", "beta"]))


@query("a15_full_year_mean", """
with y as (select slug, year(month) y, count(r) n, product(1 + r) - 1 r from manager_returns group by 1, 2)
select slug, count(*) as years, round(avg(r), 6) as mean_year from y where n = 12 group by 1""")
def _(tb):
    from ..operators.composite import full_year_mean

    return tidy(full_year_mean(tb.manager_returns, "r", "slug"))


INDEXED = """with i as (select slug, month, r, year(month) * 12 + month(month) ix from manager_returns), g as (select *, ix - row_number() over (partition by slug order by ix) run from i),
s as (select slug, run, count(*) n from g group by 1, 2), b as (select slug, run from (select *, row_number() over (partition by slug order by n desc, run) k from s) where k = 1), best as (select g.* from g join b on g.slug = b.slug and g.run = b.run)"""


def _run(tb):
    from ..operators.composite import longest_run

    return longest_run(tb.manager_returns.withColumn("ix", F.year("month") * 12 + F.month("month")), "ix", "r", "slug")


@query("w05_longest_run", INDEXED + " select slug, count(*) as n, min(month) as first, max(month) as last from best group by 1")
def _(tb):
    return _run(tb).groupBy("slug").agg(F.count("*").alias("n"), F.min("month").alias("first"), F.max("month").alias("last"))


@query("a16_series_summary", INDEXED + """ select slug, count(r) as n, round(product(1 + r) - 1, 6) as cumulative, round(pow(product(1 + r), 12.0 / count(r)) - 1, 6) as annualized, round(avg(r), 6) as mean, round(stddev_samp(r), 6) as sd,
  round(min(r), 6) as worst, round(max(r), 6) as best from best group by 1""")
def _(tb):
    from ..operators.composite import series_summary

    return tidy(series_summary(_run(tb), "r", 12, "slug"))


@query("a41_calendar_years", "select slug, cast(year(month) as int) as year, round(product(1 + r) - 1, 6) as r from manager_returns group by 1, 2")
def _(tb):
    return tidy(tb.manager_returns.groupBy("slug", F.year("month").alias("year")).agg((F.product(1 + F.col("r")) - 1).alias("r")))


@query("k24_capture", """select slug, round(avg(case when r_b > 0 then r_p end) / avg(case when r_b > 0 then r_b end), 6) as up, round(avg(case when r_b <= 0 then r_p end) / avg(case when r_b <= 0 then r_b end), 6) as down
  from aligned group by slug having count(*) filter (where r_b > 0) >= 5""")
def _(tb):
    m = lambda c, on: F.avg(F.when(on, F.col(c)))
    up, dn = F.col("r_b") > 0, F.col("r_b") <= 0
    rows = tb.aligned.groupBy("slug").agg(F.count_if(up).alias("nu"), F.count_if(dn).alias("nd"), F.try_divide(m("r_p", up), m("r_b", up)).alias("up"), F.try_divide(m("r_p", dn), m("r_b", dn)).alias("down"))
    return tidy(rows.where("nu >= 5").select("slug", "up", "down"))


@query("j21_common_months", """with s as (select slug from manager_returns group by 1 order by count(*) desc, slug limit 5)
select month from manager_returns where slug in (select slug from s) group by month having count(distinct slug) = 5""")
def _(tb):
    few = tb.manager_returns.groupBy("slug").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "slug").limit(5)
    return tb.manager_returns.join(few, "slug", "left_semi").groupBy("month").agg(F.countDistinct("slug").alias("k")).where("k = 5").select("month")
