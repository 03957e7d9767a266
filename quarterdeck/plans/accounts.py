"""Queries on account statements and composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composite as k
from ..operators import statements as s
from .registry import query, tidy

INSIDE = """
with inside as (select s.statement_id, f.date, f.amount, date_diff('day', f.date, s.period_end) / (date_diff('day', s.period_start, s.period_end) + 1.0) w
  from statements s join flows f on s.account_id = f.account_id and f.date between s.period_start and s.period_end),
fs as (select statement_id, sum(case when amount > 0 then amount else 0 end) deposits, sum(case when amount < 0 then -amount else 0 end) withdrawals, sum(w * amount) weighted, count(*) n_flows from inside group by 1),
ps as (select statement_id, sum(market_value) positions_sum, count(*) n_positions, min(as_of_date) first_date, max(as_of_date) last_date from positions group by 1),
prev as (select *, lag(period_end) over w prev_end, lag(ending_value) over w prev_value, lag(statement_id) over w prev_id from statements window w as (partition by account_id order by period_end, statement_id)),
j as (select p.*, coalesce(deposits, 0) deposits, coalesce(withdrawals, 0) withdrawals, coalesce(weighted, 0) weighted, coalesce(n_flows, 0) n_flows, positions_sum, coalesce(n_positions, 0) n_positions, first_date, last_date,
  coalesce(date_diff('day', prev_end, period_start) = 1, false) contiguous from prev p left join fs on p.statement_id = fs.statement_id left join ps on p.statement_id = ps.statement_id),
u as (select *, coalesce(beginning_value, case when contiguous then prev_value end) begin_used, deposits - withdrawals net from j),
v as (select *, ending_value - begin_used - net pnl, case when begin_used + weighted > 0 then (ending_value - begin_used - net) / (begin_used + weighted) end r from u),
t as (select *, beginning_value is not null and contiguous c1, coalesce(abs(beginning_value - prev_value) <= greatest(1, 1e-4 * greatest(abs(beginning_value), abs(prev_value))), false) o1,
  stated_deposits is not null c2, coalesce(abs(deposits - stated_deposits) <= greatest(1, 1e-4 * greatest(abs(deposits), abs(stated_deposits))), false) o2,
  stated_withdrawals is not null c3, coalesce(abs(withdrawals - stated_withdrawals) <= greatest(1, 1e-4 * greatest(abs(withdrawals), abs(stated_withdrawals))), false) o3,
  n_positions > 0 c4, coalesce(abs(positions_sum - ending_value) <= greatest(1, 1e-4 * greatest(abs(positions_sum), abs(ending_value))), false) o4,
  begin_used is not null and stated_pnl is not null c5, coalesce(abs(pnl - stated_pnl) <= greatest(1, 1e-4 * greatest(abs(pnl), abs(stated_pnl))), false) o5,
  r is not null and stated_return_pct is not null c6, coalesce(abs(r * 100 - stated_return_pct) <= 1, false) o6, coalesce(r < -0.7 or r > 1.5, false) wild from v),
flagged as (select *, list_sort(list_distinct([x for x in [
  case when ending_value < 0 then 'NEGATIVE_VALUE' end, case when ending_value = 0 then 'ZERO_VALUE' end, case when prev_end = period_end then 'DUPLICATE_PERIOD' end,
  case when prev_end <> period_end and period_start <= prev_end then 'PERIOD_OVERLAP' end, case when date_diff('day', prev_end, period_start) > 1 then 'PERIOD_GAP' end,
  case when beginning_value is not null and prev_end is not null and not contiguous then 'CHAIN_SKIPPED' end, case when beginning_value is null and contiguous then 'INFERRED_BEGINNING' end,
  case when beginning_value is null and prev_end is null then 'INCEPTION' end, case when beginning_value is null and prev_end is not null and not contiguous then 'NO_BEGINNING_VALUE' end,
  case when n_positions = 0 then 'NO_POSITIONS' end, case when first_date <> period_end or last_date <> period_end then 'POSITIONS_DATE_MISMATCH' end, case when wild then 'IMPLAUSIBLE_RETURN' end,
  case when begin_used is null and (stated_pnl is not null or stated_return_pct is not null) then 'CHECK_SKIPPED' end, case when c1 and not o1 then 'CHAIN_BREAK' end,
  case when (c2 and not o2) or (c3 and not o3) then 'FLOWS_MISMATCH' end, case when c4 and not o4 then 'POSITIONS_SUM_MISMATCH' end, case when c5 and not o5 then 'PNL_MISMATCH' end,
  case when c6 and not o6 then 'RETURN_MISMATCH' end] if x is not null])) flags,
  cast(c1 as int) + cast(c2 as int) + cast(c3 as int) + cast(c4 as int) + cast(c5 as int) + cast(c6 as int) possible,
  cast(c1 and o1 as int) + cast(c2 and o2 as int) + cast(c3 and o3 as int) + cast(c4 and o4 as int) + cast(c5 and o5 as int) + cast(c6 and o6 as int) passed,
  cast(c1 and not o1 as int) + cast(c2 and not o2 as int) + cast(c3 and not o3 as int) + cast(c4 and not o4 as int) + cast(c5 and not o5 as int) + cast(wild as int) + cast(ending_value < 0 as int)
    + cast(coalesce(prev_end = period_end, false) as int) + cast(coalesce(prev_end <> period_end and period_start <= prev_end, false) as int) failed from t),
rec as (select *, case when failed > 0 then 'flagged' when passed > 0 then 'verified' else 'unverified' end status from flagged)"""


def rec(tb):
    return s.reconcile(tb.statements, tb.flows, tb.positions)


@query("k02_reconcile", INSIDE + """ select statement_id, account_id, status, cast(possible as int) as possible, cast(passed as int) as passed, cast(failed as int) as failed, array_to_string(flags, ';') as flags, round(pnl, 2) as pnl, round(r, 6) as r from rec""")
def _(tb):
    c = F.col
    return tidy(rec(tb).select("statement_id", "account_id", "status", c("checks_possible").alias("possible"), c("checks_passed").alias("passed"), c("checks_failed").alias("failed"), F.array_join("flags", ";").alias("flags"), c("computed_pnl").alias("pnl"), c("dietz_return").alias("r")), ("pnl",))


@query("k02_flag_counts", INSIDE + """, codes as (select unnest(flags) code from rec union all select 'ORPHAN_FLOW' from flows f where not exists (select 1 from statements s where s.account_id = f.account_id and f.date between s.period_start and s.period_end))
  select code, count(*) as n from codes group by code""")
def _(tb):
    return s.flag_rows(rec(tb), s.orphan_flows(tb.statements, tb.flows)).groupBy("code").agg(F.count("*").alias("n"))


@query("p01_required_values", "select 'beginning_value' as missing, count(*) as n from statements where beginning_value is null union all select 'stated_pnl', count(*) from statements where stated_pnl is null")
def _(tb):
    return s.check_required(tb.statements, ["statement_id", "beginning_value", "stated_pnl", "period_end"]).groupBy("missing").agg(F.count("*").alias("n"))


@query("p02_duplicate_keys", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def _(tb):
    return s.check_unique(tb.lineitem, "l_orderkey", "l_linenumber")


@query("p03_period_order", "select statement_id from statements where account_id % 41 = 0")
def _(tb):
    turned = F.when(F.col("account_id") % 41 == 0, F.date_sub("period_start", 1)).otherwise(F.col("period_end"))
    return s.check_period_order(tb.statements.withColumn("period_end", turned)).select("statement_id")


@query("p04_domain", "select flow_id, flow_type from flows where flow_type not in ('deposit', 'withdrawal', 'transfer_in', 'transfer_out')")
def _(tb):
    return s.check_domain(tb.flows, "flow_type", s.FLOW_TYPES).select("flow_id", "flow_type")


@query("p05_flow_sign", "select flow_id from flows where flow_type in ('deposit', 'withdrawal') and flow_id % 10 = 3")
def _(tb):
    turned = F.when(F.col("flow_id") % 10 == 3, -F.col("amount")).otherwise(F.col("amount"))
    return s.check_flow_sign(tb.flows.withColumn("amount", turned)).select("flow_id")


@query("p08_tolerance", "select statement_id, abs(beginning_value - ending_value) <= greatest(1, 1e-4 * greatest(abs(beginning_value), abs(ending_value))) as same from statements where beginning_value is not null")
def _(tb):
    return tb.statements.where("beginning_value is not null").select("statement_id", s.matches(F.col("beginning_value"), F.col("ending_value")).alias("same"))


@query("j01_flows_in_periods", INSIDE + " select statement_id, n_flows, round(deposits, 2) as deposits, round(withdrawals, 2) as withdrawals from fs")
def _(tb):
    f = s.flows_in_periods(tb.statements, tb.flows).groupBy("statement_id").agg(F.count("*").alias("n_flows"), F.sum(F.greatest("amount", F.lit(0.0))).alias("deposits"), F.sum(F.greatest(-F.col("amount"), F.lit(0.0))).alias("withdrawals"))
    return tidy(f, ("deposits", "withdrawals"))


@query("j02_orphan_flows", "select flow_id, account_id from flows f where not exists (select 1 from statements s where s.account_id = f.account_id and f.date between s.period_start and s.period_end)")
def _(tb):
    return s.orphan_flows(tb.statements, tb.flows).select("flow_id", "account_id")


@query("j03_orphan_positions", "select statement_id, identifier from positions where account_id % 31 = 0")
def _(tb):
    return s.orphan_positions(tb.positions, tb.statements.where("account_id % 31 <> 0")).select("statement_id", "identifier")


@query("j04_silent_accounts", "select account_id from accounts where account_id not in (select account_id from statements)")
def _(tb):
    return s.silent_accounts(tb.accounts, tb.statements).select("account_id")


@query("j05_position_sums", "select statement_id, round(sum(market_value), 2) as positions_sum, count(*) as n_positions, min(as_of_date) as first_date, max(as_of_date) as last_date from positions group by 1")
def _(tb):
    return tidy(s.position_sums(tb.positions), ("positions_sum",))


@query("w01_previous_statement", INSIDE + " select statement_id, prev_id, prev_end, round(prev_value, 2) as prev_value from prev")
def _(tb):
    return tidy(s.previous(tb.statements).select("statement_id", "prev_id", "prev_end", "prev_value"), ("prev_value",))


@query("w02_gaps", INSIDE + " select account_id, statement_id, prev_id, date_diff('day', prev_end, period_start) - 1 as gap_days from prev where date_diff('day', prev_end, period_start) > 1")
def _(tb):
    return s.gaps(tb.statements)


@query("a10_reconcile_summary", INSIDE + """ select count(*) as statements, count(distinct account_id) as accounts, count(*) filter (where status = 'verified') as verified, count(*) filter (where status = 'unverified') as unverified,
  count(*) filter (where status = 'flagged') as flagged, cast(sum(possible) as bigint) as possible, cast(sum(passed) as bigint) as passed, cast(sum(failed) as bigint) as failed from rec""")
def _(tb):
    return s.summary(rec(tb))


@query("a11_coverage_years", INSIDE + """,
by_year as (select account_id, cast(year(period_end) as int) y, min(case status when 'flagged' then 0 when 'unverified' then 1 else 2 end) rk, count(*) n from rec group by 1, 2),
spine as (select account_id, unnest(generate_series(min(y), max(y))) y from by_year group by 1)
select a.account_id as account_id, cast(a.y as int) as year, case when n is null then '-' else case rk when 0 then 'flagged' when 1 then 'unverified' else 'verified' end || case when n > 1 then ' x' || n else '' end end as cell
from spine a left join by_year b on a.account_id = b.account_id and a.y = b.y""")
def _(tb):
    return s.coverage_years(rec(tb))


@query("a12_account_coverage", INSIDE + """,
g as (select account_id, count(*) n_gaps, sum(date_diff('day', prev_end, period_start) - 1) gap_days from prev where date_diff('day', prev_end, period_start) > 1 group by 1),
b as (select account_id, min(period_start) first, max(period_end) last, count(*) n, sum(date_diff('day', period_start, period_end) + 1) covered, count(*) filter (where status = 'verified') verified,
  count(*) filter (where status = 'unverified') unverified, count(*) filter (where status = 'flagged') flagged from rec group by 1)
select b.account_id as account_id, first, last, n, verified, unverified, flagged, coalesce(n_gaps, 0) as n_gaps, cast(coalesce(gap_days, 0) as bigint) as gap_days, round(covered / (date_diff('day', first, last) + 1), 6) as share
from b left join g on b.account_id = g.account_id""")
def _(tb):
    return tidy(s.account_coverage(rec(tb)))


RETURNS = INSIDE + """,
pr as (select statement_id, account_id, period_start, period_end, date_diff('day', period_start, period_end) + 1 as days, begin_used, ending_value, net, case when begin_used is not null then weighted end weighted, n_flows, r, coalesce(begin_used > 0, false) full_period, status evidence from rec),
ok as (select *, r is not null and evidence <> 'flagged' ok, lag(r is not null and evidence <> 'flagged') over w was, lag(period_end) over w last_end from pr window w as (partition by account_id order by period_start, statement_id)),
seg as (select *, sum(case when ok and coalesce(was, false) and date_diff('day', last_end, period_start) = 1 then 0 else 1 end) over (partition by account_id order by period_start, statement_id) segment from ok),
good as (select * from seg where ok),
sizes as (select account_id, segment, count(*) n from good group by 1, 2),
best as (select account_id, segment from (select *, row_number() over (partition by account_id order by n desc, segment) k from sizes) where k = 1),
longest as (select g.* from good g join best b on g.account_id = b.account_id and g.segment = b.segment)"""


def periods(tb):
    """The reconciled statements are gone through several times: what periods need of them is worked out once."""
    tb.kept("statements")
    need = ["statement_id", "account_id", "period_start", "period_end", "beginning_used", "ending_value", "status"]
    return s.period_returns(tb.kept("reconciled", lambda: rec(tb).select(*need)), tb.flows)


@query("k04_period_returns", RETURNS + " select statement_id, account_id, cast(days as int) as days, round(net, 2) as net_flows, n_flows, round(r, 6) as r, full_period, evidence from pr")
def _(tb):
    return tidy(periods(tb).select("statement_id", "account_id", "days", "net_flows", "n_flows", "r", "full_period", "evidence"), ("net_flows",))


@query("k03_modified_dietz", INSIDE + " select statement_id, round(r, 6) as r from rec where r is not null")
def _(tb):
    return tidy(rec(tb).where("dietz_return is not null").select("statement_id", F.col("dietz_return").alias("r")))


@query("w03_segments", RETURNS + " select account_id, statement_id, cast(dense_rank() over (partition by account_id order by segment) as int) as segment from good")
def _(tb):
    from pyspark.sql import Window

    return s.segments(periods(tb)).select("account_id", "statement_id", F.dense_rank().over(Window.partitionBy("account_id").orderBy("segment")).alias("segment"))


@query("w04_longest_segment", RETURNS + " select account_id, count(*) as n, min(period_start) as first, max(period_end) as last from longest group by 1")
def _(tb):
    return s.longest_segment(s.segments(periods(tb))).groupBy("account_id").agg(F.count("*").alias("n"), F.min("period_start").alias("first"), F.max("period_end").alias("last"))


PERFORMANCE = """select account_id, min(period_start) as start, max(period_end) as stop, count(*) as n, sum(days) / 365.25 as years, product(1 + r) - 1 as cumulative, avg(r) as mean, arg_min(begin_used, period_start) b, arg_max(ending_value, period_start) e from longest group by 1"""


@query("a13_account_performance", RETURNS + f", p as ({PERFORMANCE})" + """
select account_id, start, stop, n, round(years, 6) as years, round(cumulative, 6) as cumulative, round(mean, 6) as mean, round(case when cumulative > -1 then pow(1 + cumulative, 1 / years) - 1 end, 6) as annualized,
  round(case when b > 0 and e > 0 then pow(e / b, 1 / years) - 1 end, 6) as naive_cagr from p""")
def _(tb):
    return tidy(s.account_performance(tb.kept("periods", lambda: periods(tb))))


@query("a14_chain", RETURNS + " select account_id, round(product(1 + r) - 1, 6) as chained from longest group by 1")
def _(tb):
    return tidy(s.longest_segment(s.segments(periods(tb))).groupBy("account_id").agg(s.growth(F.col("r")).alias("chained")))


@query("k06_segment_cashflows", RETURNS + """,
span as (select account_id, min(period_start) a, max(period_end) z, arg_min(begin_used, period_start) b, arg_max(ending_value, period_start) e from longest group by 1)
select account_id, cast(a - interval '1' day as date) as date, round(-b, 2) as amount from span where b <> 0 union all select f.account_id, f.date, round(-amount, 2) from span s join flows f on s.account_id = f.account_id and f.date between a and z
union all select account_id, z, round(e, 2) from span where e <> 0""")
def _(tb):
    return tidy(s.segment_cashflows(s.longest_segment(s.segments(periods(tb))), tb.flows), ("amount",))


@query("k05_xirr")
def _(tb):
    seg = s.longest_segment(s.segments(periods(tb)))
    return tidy(s.xirr(s.segment_cashflows(seg, tb.flows), "account_id"))


CLASSIFIED = RETURNS + """,
last_ones as (select account_id, arg_max(ending_value, period_end) v, max(period_end) e from statements group by 1),
alive as (select account_id from last_ones where e = (select max(period_end) from statements) and v > 0),
cl as (select p.*, cast(year(period_end) as int) cell, coalesce(owner_type, 'client') owner, case when a.account_id is null then 'not_in_accounts_csv' when upper(discretionary) <> 'Y' then 'non_discretionary' when r is null then 'no_return'
  when not full_period then 'partial_period' when evidence = 'flagged' then 'flagged' else '' end reason, p.account_id in (select account_id from alive) survivor
  from pr p left join accounts a on p.account_id = a.account_id),
el as (select * from cl where reason = ''),
comp as (select cell, count(*) n, sum(begin_used) begin_assets, sum(ending_value) end_assets, sum(net) net_flows, (sum(ending_value) - sum(begin_used) - sum(net)) / (sum(begin_used) + sum(weighted)) gross,
  sum(begin_used * r) / sum(begin_used) asset_weighted, avg(r) equal_weighted, max(r) high, min(r) low, count(*) filter (where survivor) n_survivors,
  (sum(ending_value) filter (where survivor) - sum(begin_used) filter (where survivor) - sum(net) filter (where survivor)) / (sum(begin_used) filter (where survivor) + sum(weighted) filter (where survivor)) survivors_only,
  count(*) filter (where owner <> 'principal') n_clients,
  (sum(ending_value) filter (where owner <> 'principal') - sum(begin_used) filter (where owner <> 'principal') - sum(net) filter (where owner <> 'principal')) / (sum(begin_used) filter (where owner <> 'principal') + sum(weighted) filter (where owner <> 'principal')) clients_only,
  count(*) filter (where owner = 'principal') n_principal,
  (sum(ending_value) filter (where owner = 'principal') - sum(begin_used) filter (where owner = 'principal') - sum(net) filter (where owner = 'principal')) / (sum(begin_used) filter (where owner = 'principal') + sum(weighted) filter (where owner = 'principal')) principal_only,
  count(*) filter (where evidence = 'verified') n_verified, count(*) filter (where evidence = 'unverified') n_unverified from el group by 1)"""


def classified(tb):
    return k.classify(periods(tb), tb.accounts)


def cells(tb):
    return k.build(classified(tb), k.survivors(tb.statements))


@query("p06_grid_cells", "select statement_id, cast(year(period_end) as int) as cell from statements")
def _(tb):
    return tb.statements.select("statement_id", k.cell(F.col("period_start"), F.col("period_end")).alias("cell"))


@query("p07_classify", CLASSIFIED + " select statement_id, cell, reason as exclusion_reason, owner as owner_type from cl")
def _(tb):
    return classified(tb).select("statement_id", "cell", "exclusion_reason", "owner_type")


@query("j06_account_metadata", "select statement_id, owner_type, discretionary from statements s left join accounts a on s.account_id = a.account_id")
def _(tb):
    return tb.statements.join(tb.accounts, "account_id", "left").select("statement_id", "owner_type", "discretionary")


@query("a09_survivors", CLASSIFIED + " select account_id from alive")
def _(tb):
    return k.survivors(tb.statements)


@query("a05_composite_returns", CLASSIFIED + " select cell, n, round(gross, 6) as gross, round(asset_weighted, 6) as asset_weighted, round(equal_weighted, 6) as equal_weighted from comp")
def _(tb):
    return tidy(cells(tb).select("cell", "n", "gross", "asset_weighted", "equal_weighted"))


@query("a06_dispersion", CLASSIFIED + """ select e.cell as cell, round(sqrt(sum(begin_used * pow(r - asset_weighted, 2)) / sum(begin_used)), 6) as dispersion_sd, round(max(high), 6) as high, round(max(low), 6) as low
  from el e join comp c on e.cell = c.cell group by e.cell having count(*) >= 6""")
def _(tb):
    return tidy(cells(tb).where("dispersion_sd is not null").select("cell", "dispersion_sd", "high", "low"))


@query("a07_variants", CLASSIFIED + " select cell, n_survivors, round(survivors_only, 6) as survivors_only, n_clients, round(clients_only, 6) as clients_only, n_principal, round(principal_only, 6) as principal_only from comp")
def _(tb):
    return tidy(cells(tb).select("cell", "n_survivors", "survivors_only", "n_clients", "clients_only", "n_principal", "principal_only"))


@query("a08_exclusions", CLASSIFIED + """ select c.cell as cell, n_verified, n_unverified, count(*) filter (where reason = 'flagged') as n_excluded_flagged, count(*) filter (where reason = 'partial_period') as n_excluded_partial,
  count(*) filter (where reason in ('non_discretionary', 'other_strategy', 'no_return', 'not_grid_aligned')) as n_excluded_other from cl c join comp p on c.cell = p.cell group by 1, 2, 3""")
def _(tb):
    return cells(tb).select("cell", "n_verified", "n_unverified", "n_excluded_flagged", "n_excluded_partial", "n_excluded_other")


@query("k07_composite", CLASSIFIED + " select cell, n, round(begin_assets, 2) as begin_assets, round(end_assets, 2) as end_assets, round(net_flows, 2) as net_flows, round(gross, 6) as gross from comp")
def _(tb):
    return tidy(cells(tb).select("cell", "n", "begin_assets", "end_assets", "net_flows", "gross"), ("begin_assets", "end_assets", "net_flows"))


@query("w16_model_net", CLASSIFIED + """,
o as (select cell, gross, row_number() over (order by cell) k from comp),
walk as (with recursive w as (select k, cell, gross, 1.0::double as prev, 1.0::double as hwm0, case when (1 + gross) * 0.995 > 1 then (1 + gross) * 0.995 - 0.2 * ((1 + gross) * 0.995 - 1) else (1 + gross) * 0.995 end nav from o where k = 1
  union all select o.k, o.cell, o.gross, w.nav, greatest(w.hwm0, w.nav), case when w.nav * (1 + o.gross) * 0.995 > greatest(w.hwm0, w.nav) then w.nav * (1 + o.gross) * 0.995 - 0.2 * (w.nav * (1 + o.gross) * 0.995 - greatest(w.hwm0, w.nav))
    else w.nav * (1 + o.gross) * 0.995 end from w join o on o.k = w.k + 1) select * from w)
select cell, round(nav / prev - 1, 6) as model_net from walk""")
def _(tb):
    return tidy(k.model_net(cells(tb).select("cell", "gross", F.lit(1.0).alias("years")), "cell"))


@query("a38_trailing_windows", CLASSIFIED + """,
r as (select *, row_number() over (order by cell desc) k from comp), h as (select unnest([1, 2, 3, 5]) h)
select h, count(*) as n, round(product(1 + gross) - 1, 6) as total, round(sum(n_verified) / sum(n), 6) as verified_share from r join h on k <= h group by h having count(*) = h""")
def _(tb):
    return tidy(k.trailing(cells(tb), "gross", [1, 2, 3, 5]))


@query("a39_variant_gaps", CLASSIFIED + """ select cell, round(survivors_only - gross, 6) as survivors_only_gap, round(clients_only - gross, 6) as clients_only_gap, round(principal_only - gross, 6) as principal_only_gap,
  round(principal_only - clients_only, 6) as principal_less_clients from comp""")
def _(tb):
    return tidy(k.variant_gaps(cells(tb)))


@query("a37_evidence", INSIDE + " select status, count(*) as n, round(count(*) / (select count(*) from rec), 6) as share from rec group by status")
def _(tb):
    r = rec(tb).groupBy("status").agg(F.count("*").alias("n"))
    return tidy(r.crossJoin(F.broadcast(r.agg(F.sum("n").alias("all")))).select("status", "n", (F.col("n") / F.col("all")).alias("share")))  # three rows and one
