"""Queries on raw formats, written from the tables and read back, and on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..sources import readers as s
from ..sources.kept import shared_place
from ..streaming import jobs as j
from .registry import query, tidy

@query("f01_numbers", "select o_orderkey, case when o_orderkey % 9 = 0 then 0.0 when o_orderkey % 2 = 0 then -o_totalprice else o_totalprice end as value from orders")
def _(tb):
    printed = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    text = F.when(F.col("o_orderkey") % 9 == 0, "-").when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("("), printed, F.lit(")"))).otherwise(F.concat(F.lit(" "), printed))
    return tb.orders.select("o_orderkey", c.number(text).alias("value"))


@query("f02_dates", "select o_orderkey, cast(o_orderdate as date) as date from orders")
def _(tb):
    forms = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "M/d/yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format("o_orderdate", "d MMM yyyy"))
    return tb.orders.select("o_orderkey", c.date(forms).alias("date"))


@query("f03_calendar", """select distinct cast(o_orderdate as date) as d, last_day(cast(o_orderdate as date)) as month_end, last_day(cast(date_trunc('quarter', o_orderdate) + interval '2' month as date)) as quarter_end,
  cast(date_trunc('month', o_orderdate) - interval '1' day as date) as previous_month, date_diff('day', date_trunc('month', o_orderdate), last_day(cast(o_orderdate as date))) + 1 as days from orders""")
def _(tb):
    d = F.to_date("o_orderdate")
    return tb.orders.select(d.alias("d")).distinct().select("d", F.last_day("d").alias("month_end"), c.quarter_end(F.col("d")).alias("quarter_end"), c.previous_month(F.col("d")).alias("previous_month"), c.days_inclusive(F.trunc("d", "month"), F.last_day("d")).alias("days"))


@query("f04_normal_cdf")
def _(tb):
    return tidy(tb.factors.select("month", c.normal_cdf(F.col("smb") * 10).alias("p"), c.clip(F.col("smb"), -0.1, 0.1).alias("clipped")))


@query("f05_issuer_names", "select s_suppkey, upper(replace(s_name, '#', ' ')) as name from supplier")
def _(tb):
    noisy = F.concat(F.lit("The "), "s_name", F.when(F.col("s_suppkey") % 2 == 0, " Holdings, Inc.").otherwise(" CL A Corp"))
    return tb.supplier.select("s_suppkey", c.issuer_name(noisy).alias("name"))


@query("j10_names_to_tickers", "select s_suppkey, min(s_suppkey) over (partition by s_nationkey) as ticker from supplier")
def _(tb):
    names = tb.supplier.select("s_suppkey", c.issuer_name(F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"), F.lit(" Group Ltd"))).alias("k"))
    table = tb.supplier.select(c.issuer_name(F.concat(F.lit("The Nation "), F.col("s_nationkey").cast("string"), F.lit(" Co"))).alias("k"), "s_suppkey").groupBy("k").agg(F.min("s_suppkey").alias("ticker"))
    return names.join(table, "k", "left").select("s_suppkey", "ticker")


@query("f06_identifiers", "select c_custkey, right(cast(10000 + c_custkey as varchar), 4) as last4, lower(replace(c_name, '#', '-')) as slug from customer")
def _(tb):
    return tb.customer.select("c_custkey", c.last4(F.concat(F.lit("XX-"), (F.col("c_custkey") + 10000).cast("string"))).alias("last4"), c.slug(F.col("c_name")).alias("slug"))


@query("s01_conform_flows", "select account_id, date, round(amount, 2) as amount, flow_type from flows")
def _(tb):
    raw = tb.flows.select(F.concat(F.lit(" "), F.col("account_id").cast("string")).alias("account_id"), F.col("date").cast("string").alias("date"), F.concat(F.lit("$"), F.format_number("amount", 2)).alias("amount"), "flow_type")
    return s.conform(raw, "flows").select(F.col("account_id").cast("long").alias("account_id"), "date", "amount", "flow_type")


def texts(tb):
    st = tb.statements.where("beginning_value is not null and stated_deposits is not null")
    m = lambda x: F.concat(F.lit("$"), F.format_number(x, 2))
    return st.select(
        F.col("statement_id").alias("doc"), "account_id",
        F.concat_ws("\n", F.lit("Quarterly report"), F.concat(F.lit("Account number: XXXX-"), F.lpad((F.col("account_id") % 10000).cast("string"), 4, "0")),
                    F.concat(F.lit("Statement period "), F.date_format("period_start", "MMMM d, yyyy"), F.lit(" to "), F.date_format("period_end", "MMMM d, yyyy")),
                    F.concat(F.lit("Beginning value  "), m("beginning_value")), F.concat(F.lit("Deposits  "), m("stated_deposits")), F.concat(F.lit("Withdrawals  "), m("stated_withdrawals")), F.concat(F.lit("Ending value  "), m("ending_value")),
                    F.lit("            Opening      Closing"), F.concat(F.lit("Stocks  "), m("beginning_value"), F.lit("  "), m("ending_value")), F.concat(F.lit("Total  "), m("beginning_value"), F.lit("  "), m("ending_value")),
                    F.concat(F.date_format("period_start", "M/d/yyyy"), F.lit("  Wire deposit received  "), m("stated_deposits")), F.concat(F.date_format("period_end", "M/d/yyyy"), F.lit("  Withdrawal sent to bank  "), m("stated_withdrawals")),
                    F.concat(F.date_format("period_end", "M/d/yyyy"), F.lit("  Bought 10 shares  $5.00"))).alias("text"),
    )


TEXT = "from statements where beginning_value is not null and stated_deposits is not null"


@query("s15_statement_fields", f"""select statement_id as doc, period_start, period_end, right(concat('0000', cast(account_id % 10000 as varchar)), 4) as account_id, round(beginning_value, 2) as beginning_value, round(ending_value, 2) as ending_value,
  round(stated_deposits, 2) as stated_deposits, round(stated_withdrawals, 2) as stated_withdrawals {TEXT}""")
def _(tb):
    return s.extract_statement_fields(texts(tb)).select("doc", "period_start", "period_end", "account_id", "beginning_value", "ending_value", "stated_deposits", "stated_withdrawals")


@query("s16_two_columns", f"select statement_id as doc, round(beginning_value, 2) as opening, round(ending_value, 2) as closing {TEXT}")
def _(tb):
    return tidy(s.extract_two_column(texts(tb)), ("opening", "closing"))


@query("s17_transfers", f"""select statement_id as doc, period_start as date, round(stated_deposits, 2) as amount, 'deposit' as flow_type {TEXT} union all
  select statement_id, period_end, case when round(stated_withdrawals, 2) = 0 then 0 else -round(stated_withdrawals, 2) end, 'withdrawal' {TEXT}""")
def _(tb):
    return s.extract_transfers(texts(tb)).withColumn("amount", F.when(F.col("amount") == 0, 0.0).otherwise(F.col("amount")))


@query("s18_assembled")
def _(tb):
    st, fl = s.assemble_statements(s.extract_statement_fields(texts(tb)), s.extract_transfers(texts(tb)), least=3)
    return st.groupBy("account_id").agg(F.count("*").alias("statements"), F.count_if("trusted").alias("trusted")).join(fl.groupBy("account_id").agg(F.count("*").alias("flows")), "account_id", "left")


@query("p15_grid", """with g as (select account_id, date_diff('day', lag(date) over (partition by account_id order by date), date) gap from flows)
  select account_id, case when quantile_cont(gap, 0.5) < 45 then 'M' when quantile_cont(gap, 0.5) > 300 then 'A' else 'error' end as grid from g where gap is not null group by 1""")
def _(tb):
    return s.infer_grid(tb.flows, "account_id")


@query("s06_factor_file", "select month, round(mkt_rf, 6) as mkt_rf, round(smb, 6) as smb from factors where mkt_rf is not null and smb is not null")
def _(tb):
    f = tb.factors.where("mkt_rf is not null and smb is not null")
    num = lambda x: F.format_string("%.8f", F.col(x) * 100)
    lines = f.select(F.concat_ws(",", F.date_format("month", "yyyyMM"), num("mkt_rf"), num("smb"), F.lit("-99.99")).alias("value")).unionByName(tb.region.select(F.concat(F.lit("Notes on "), "r_name").alias("value")))
    return tidy(s.factor_rows(lines, "M", "mkt_rf", "smb", "hml").select("month", "mkt_rf", "smb"))


@query("s07_factor_assembly", "select month, round(mkt_rf + rf, 6) as mkt, round(mom, 6) as mom from factors")
def _(tb):
    a = tb.factors.select("month", "mkt_rf", "smb", "rf")
    return tidy(s.assemble_factors(a, tb.factors.select("month", "smb", F.col("mom").alias("wml"))).select("month", "mkt", "mom"))


@query("k16_benchmark_blend", "select month, round(0.6 * mkt_rf + 0.4 * hml, 6) as r from factors")
def _(tb):
    return tidy(s.benchmark(tb.factors, "60:mkt_rf,40:hml"))


@query("j07_compounded_benchmark", """with b as (select month, mkt_rf * 0.01 r from factors)
  select statement_id, round(case when count(r) = 12 then product(1 + r) - 1 end, 6) as bench_r from statements s left join b on b.month between s.period_start and s.period_end group by 1""")
def _(tb):
    return tidy(s.compound_over(tb.statements, tb.factors.select("month", (F.col("mkt_rf") * 0.01).alias("r"))))


@query("s09_filings_index", "select slug as cik, concat('A', cusip) as accession, filed, period from holdings where cusip % 10 <> 0")
def _(tb):
    by = tb.holdings.groupBy("slug").agg(F.collect_list(F.struct(F.concat(F.lit("A"), "cusip").alias("accessionNumber"), F.col("filed").cast("string").alias("filingDate"), F.col("period").cast("string").alias("reportDate"), F.when(F.col("cusip") % 10 == 0, "13F-NT").otherwise("13F-HR").alias("form"))).alias("x"))
    doc = F.to_json(F.struct(*[F.col(f"x.{k}").alias(k) for k in ("accessionNumber", "filingDate", "reportDate", "form")]))
    return s.filings(by.select(F.col("slug").alias("cik"), doc.alias("doc")))


@query("s10_company_facts", "select c_custkey as ticker, cast(o_orderdate as date) as \"end\", o_totalprice as value from orders join customer on o_custkey = c_custkey")
def _(tb):
    entry = F.struct(F.to_date("o_orderdate").cast("string").alias("end"), F.date_add(F.to_date("o_orderdate"), 30).cast("string").alias("filed"), F.lit("10-K").alias("form"), F.col("o_totalprice").alias("val"), F.col("o_orderkey").cast("double").alias("fy"))
    by = tb.orders.groupBy(F.col("o_custkey").alias("ticker")).agg(F.collect_list(entry).alias("e"))
    doc = F.to_json(F.create_map(F.lit("EquityOld"), F.struct(F.struct(F.col("e").alias("USD")).alias("units"))))
    return s.company_facts(by.select("ticker", doc.alias("doc")), {"equity": ["StockholdersEquity", "EquityOld"]}).select("ticker", "end", "value")


@query("s19_series_to_statements", """
with c as (select l_suppkey slug, last_day(cast(l_shipdate as date)) as month, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / 100 / sum(l_quantity) v from lineitem group by 1, 2),
d as (select a.slug, a.month, (a.v / b.v - 1) * cast(0.01 as double) r from c a join c b on a.slug = b.slug and b.month = cast(date_trunc('month', a.month) - interval '1' day as date)),
e as (select slug, month, list_reduce(list(1 + case when wild then r / 100 else r end) over (partition by slug order by month), lambda x, y: x * y) g from (select *, max(abs(r)) over (partition by slug) > 1.5 wild from d) x)
select slug, month as period_end, floor(1000000 * g * 100 + 0.5) / 100 as ending_value from e""")
def _(tb):
    """Cents are summed as whole numbers, returns chained in the order of months and cents rounded half up, so that no sum's order decides a cent."""
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double")
    values = tb.lineitem.groupBy(F.col("l_suppkey").alias("slug"), F.last_day(F.to_date("l_shipdate")).alias("month")).agg((cents / 100 / F.sum("l_quantity")).alias("v"))
    before = values.select("slug", F.col("month").alias("m0"), F.col("v").alias("v0"))
    r = values.withColumn("m0", c.previous_month(F.col("month"))).join(before, ["slug", "m0"]).select("slug", "month", ((F.col("v") / F.col("v0") - 1) * 0.01).alias("r"))
    return s.returns_to_statements(r, "slug").select("slug", "period_end", (F.floor(F.col("ending_value") * 100 + 0.5) / 100).alias("ending_value"))


@query("s13_values_to_statements", "select slug, period_end, round(v, 2) as ending_value from (select slug, month period_end, v, row_number() over (partition by slug order by month) k from manager_values) where k > 1")
def _(tb):
    st, _ = s.values_to_statements(tb.manager_values.select("slug", F.col("month").alias("date"), F.col("v").alias("value"), F.lit(None).cast("double").alias("flow")), "slug")
    return tidy(st.select("slug", "period_end", "ending_value"), ("ending_value",))


@query("s23_statement_returns", "select slug, month, round(v / lag(v) over (partition by slug order by month) - 1, 6) as r from manager_values qualify lag(v) over (partition by slug order by month) is not null")
def _(tb):
    return tidy(s.statement_returns(tb.manager_values.select("slug", F.col("month").alias("period_end"), F.col("v").alias("ending_value")), "slug"))


@query("s21_manifest", "select count(*) as n_rows, min(period) as first, max(period) as last, count(distinct slug) as n_slug, count(distinct cusip) as n_cusip from holdings")
def _(tb):
    return s.manifest(tb.holdings, "period", "slug", "cusip")


def _events(tb):
    return tb.spark.readStream.schema(tb.events.schema).parquet(f"{tb.sf_dir}/event*.parquet")


def _place(tb):
    return shared_place(tb.spark, "stream")


@query("t03_tumbling_days", "select time_bucket(interval '1' day, ts) as start, count(*) as n, round(sum(value), 4) as total from events group by 1")
def _(tb):
    out = j.run_to_files(j.tumbling(_events(tb), "ts", "1 day", "value"), "complete", _place(tb))
    return out.withColumn("total", F.round("total", 4))


@query("t01_ingest", "select event_type, count(*) as n from events group by 1")
def _(tb):
    place = _place(tb)
    for _ in range(2):  # the second run finds nothing new
        j.ingest(_events(tb), f"{place}/out", f"{place}/checkpoint")
    return tb.spark.read.parquet(f"{place}/out").groupBy("event_type").agg(F.count("*").alias("n"))


def _written(tb, df):
    place = f"{_place(tb)}/in"
    df.write.parquet(place)
    return tb.spark.readStream.schema(df.schema).parquet(place)


@query("t02_in_time_filings", "select slug, period, count(*) as n from holdings where filed <= last_day(cast(period + interval '2' month as date)) group by 1, 2")
def _(tb):
    h = _written(tb, tb.holdings.select("slug", "period", F.col("filed").cast("timestamp").alias("filed")))
    return j.run_to_files(j.in_time(h, "10000 days").select("slug", "period"), "append", _place(tb)).groupBy("slug", "period").agg(F.count("*").alias("n"))


@query("t04_chain_check", """with p as (select *, lag(period_end) over w pe, lag(ending_value) over w pv from statements window w as (partition by account_id order by period_end))
  select statement_id, case when date_diff('day', pe, period_start) = 1 and beginning_value is not null then cast(abs(beginning_value - pv) > greatest(1, 1e-4 * greatest(abs(beginning_value), abs(pv))) as int) end as broken,
    date_diff('day', pe, period_start) - 1 as gap_days from p""")
def _(tb):
    st = _written(tb, tb.statements.select("account_id", "statement_id", "period_start", "period_end", "beginning_value", "ending_value"))
    return j.run_to_files(j.chain_check(st), "append", _place(tb)).select("statement_id", F.col("broken").cast("int").alias("broken"), "gap_days")


@query("t05_position_expiry", "select slug, max(filed) as filed, last_day(cast(max(filed) + interval '4' month as date)) as expires from holdings group by 1")
def _(tb):
    h = _written(tb, tb.holdings.select("slug", "filed"))
    return j.run_to_files(j.latest_positions(h), "complete", _place(tb))


@query("f11_market_impact", "select l_orderkey, l_linenumber, round(0.001 + 0.02 * sqrt(l_quantity / 5000.0), 6) as cost from lineitem")
def _(tb):
    from ..functions.columns import market_impact

    return tidy(tb.lineitem.select("l_orderkey", "l_linenumber", market_impact(F.col("l_quantity") / 5000.0, F.lit(0.02)).alias("cost")))


@query("f08_dot_products", "select slug, count(*) as n, round(sum(r_p * mkt_rf), 6) as dot from aligned group by 1")
def _(tb):
    from ..functions.columns import dot

    rows = tb.aligned.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("month", "r_p", "mkt_rf"))).alias("x"))  # a record's months
    return tidy(rows.select("slug", F.size("x").cast("long").alias("n"), dot(F.col("x.r_p"), F.col("x.mkt_rf")).alias("dot")))
