"""Domain tables worked out from the supplied tables, by SQL text that both Spark and the checking engine run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.kept import kept

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
BEFORE = "cast(cast(date_trunc('month', {}) as date) - interval '1' day as date)"

TABLES = {
    # quarterly holdings: a manager is a supplier, a security a part; some lines are options, some filings late
    "holdings": """
        select slug, period, cast(period + cast(slug * 7 % 70 as int) as date) filed, cusip, name, putcall, value, shares from (
          select l_suppkey slug, last_day(cast(cast(date_trunc('quarter', l_shipdate) as date) + interval '2' month as date)) period,
            l_partkey cusip, p_name name,
            case when l_returnflag = 'R' and l_discount > 0.085 then 'put' when l_returnflag = 'A' and l_discount > 0.085 then 'call' else '' end putcall,
            sum(l_extendedprice) value, sum(l_quantity) shares
          from {lineitem} join {part} on l_partkey = p_partkey group by 1, 2, 3, 4, 5) h""",
    # lines of holdings without an option, before they are added up: the quarter is worked out here, so that few columns are dealt
    "long_lines": """
        select l_suppkey slug, l_partkey cusip, last_day(cast(cast(date_trunc('quarter', l_shipdate) as date) + interval '2' month as date)) period, l_extendedprice value, l_quantity shares
        from {lineitem} where case when l_returnflag = 'R' and l_discount > 0.085 then 'put' when l_returnflag = 'A' and l_discount > 0.085 then 'call' else '' end = ''""",
    "cusip_map": "select p_partkey cusip, case when p_partkey % 20 = 0 then null else concat(p_brand, '/', p_type) end ticker from {part}",
    "funds": """
        select s_suppkey slug, s_name manager, r_name region,
          case s_suppkey % 9 when 0 then 'ls' when 1 then 'conc' when 2 then 'act' when 3 then 'event' when 4 then 'multi' when 5 then 'macro' when 6 then 'fo' when 7 then 'lo' else 'mm' end style
        from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "sectors": "select distinct concat(p_brand, '/', p_type) ticker, p_type sector from {part} where p_partkey % 20 <> 0",
    "prices": """
        select ticker, last_day(cast(l_shipdate as date)) as month, sum(l_extendedprice) / sum(l_quantity) price
        from {lineitem} join {cusip_map} on l_partkey = cusip where ticker is not null group by 1, 2""",
    "ticker_returns": "select a.ticker, a.month, a.price / b.price - 1 r from {prices} a join {prices} b on a.ticker = b.ticker and b.month = " + BEFORE.format("a.month"),
    "traits": """
        select concat(p_brand, '/', p_type) ticker, avg(p_size) size, avg(p_retailprice) level, count(*) parts, min(length(p_name)) shortest, max(p_partkey) % 2 odd
        from {part} where p_partkey % 20 <> 0 group by 1""",
    # facts of each ticker and quarter: some share counts a thousandfold, some filers foreign
    "fact_base": """
        select concat(p_brand, '/', p_type) ticker, last_day(cast(cast(date_trunc('quarter', l_shipdate) as date) + interval '2' month as date)) ends,
          sum(l_quantity) q, sum(l_extendedprice) v, sum(l_extendedprice * l_discount) d, case when min(p_size) % 7 = 0 then '20-F' else '10-Q' end form, case when min(p_size) % 5 = 0 then 1000 else 1 end unit
        from {lineitem} join {part} on l_partkey = p_partkey where p_partkey % 20 <> 0 group by 1, 2""",
    "facts": """
        select ticker, fact, start, ends, cast(ends + cast(30 + length(ticker) as int) as date) filed, value, form from (
          select ticker, 'shares' fact, cast(null as date) start, ends, q * case when month(ends) = 9 then unit else 1 end value, form from {fact_base}
          union all select ticker, 'equity', cast(null as date), ends, v * 0.4 - 9000, form from {fact_base}
          union all select ticker, 'assets', cast(null as date), ends, v, form from {fact_base}
          union all select ticker, 'net_income', cast(ends - interval '364' day as date), ends, d - 0.04 * v, form from {fact_base}
          union all select ticker, 'op_cf', cast(ends - interval '364' day as date), ends, 0.1 * v - d, form from {fact_base}) f""",
    "factors": """
        select month, avg(r) - cast(0.002 as double) mkt_rf, avg(case when size < (select avg(size) from {traits}) then r end) - avg(case when size >= (select avg(size) from {traits}) then r end) smb,
          avg(case when level < (select avg(level) from {traits}) then r end) - avg(case when level >= (select avg(level) from {traits}) then r end) hml,
          avg(case when odd = 0 then r end) - avg(case when odd = 1 then r end) mom,
          avg(case when parts % 2 = 0 then r end) - avg(case when parts % 2 = 1 then r end) rmw,
          avg(case when r.ticker like '%1/%' then r end) - avg(case when r.ticker not like '%1/%' then r end) cma, cast(0.002 as double) rf
        from {ticker_returns} r join {traits} t on r.ticker = t.ticker group by month""",
    "manager_values": "select l_suppkey slug, last_day(cast(l_shipdate as date)) as month, sum(l_extendedprice) / sum(l_quantity) v from {lineitem} group by 1, 2",
    "manager_returns": "select a.slug, a.month, a.v / b.v - 1 r from {manager_values} a join {manager_values} b on a.slug = b.slug and b.month = " + BEFORE.format("a.month"),
    "aligned": """
        select slug, m.month, r r_p, mkt_rf + rf r_b, r - rf y, mkt_rf y_b, mkt_rf, smb, hml, mom, rmw, cma, rf
        from {manager_returns} m join {factors} f on m.month = f.month where mkt_rf is not null and smb is not null and hml is not null and mom is not null and rmw is not null and cma is not null""",
    "flows": """
        select o_orderkey flow_id, o_custkey account_id, cast(o_orderdate as date) date, case when o_orderstatus = 'F' then -o_totalprice else o_totalprice end amount,
          case when o_orderkey % 50 = 0 then 'other' when o_orderstatus = 'F' then 'withdrawal' else 'deposit' end flow_type from {orders}""",
    "account_years": """
        select account_id, cast(year(date) as int) y, sum(abs(amount)) moved, sum(case when amount > 0 then amount else 0 end) dep, sum(case when amount < 0 then -amount else 0 end) wdr
        from {flows} group by 1, 2""",
    "statements": """
        select concat('S', account_id, '-', y) statement_id, account_id, make_date(y, 1, 1) period_start, make_date(y, 12, 31) period_end, ending_value,
          case when account_id % 3 = 2 then null when account_id % 17 = 0 then before + 5 else before end beginning_value,
          case when account_id % 5 = 0 then null when account_id % 23 = 0 then dep + 10 else dep end stated_deposits,
          case when account_id % 5 = 0 then null else wdr end stated_withdrawals,
          case when account_id % 4 = 0 then ending_value - before - (dep - wdr) + case when account_id % 8 = 0 then 500 else 0 end end stated_pnl,
          case when account_id % 6 = 0 then 5.0 end stated_return_pct
        from (select account_id, y, dep, wdr, ending_value, lag(ending_value) over (partition by account_id order by y) before from (
            select account_id, y, dep, wdr, sum(moved) over (partition by account_id order by y) * 1.04 ending_value from {account_years}) a) b
        where not (account_id % 13 = 0 and y = 1998)""",
    "positions": """
        select statement_id, s.account_id, case when s.account_id % 29 = 0 then make_date(year(period_end), 12, 30) else period_end end as_of_date, identifier,
          case when pmod5 = 0 then 'us_equity' when pmod5 = 1 then 'intl_equity' when pmod5 = 2 then 'fund' when pmod5 = 3 then 'cash' else 'bond' end asset_class,
          p.value / sum(p.value) over (partition by statement_id) * ending_value * case when s.account_id % 19 = 0 then 1.02 else 1.0 end market_value
        from {statements} s join (
          select o_custkey account_id, cast(year(o_orderdate) as int) y, l_partkey identifier, l_partkey % 5 pmod5, sum(l_extendedprice) value
          from {lineitem} join {orders} on l_orderkey = o_orderkey group by 1, 2, 3, 4) p
        on s.account_id = p.account_id and year(s.period_end) = p.y""",
    "accounts": """
        select c_custkey account_id, c_name label, case when c_custkey % 10 = 0 then 'principal' else 'client' end owner_type,
          case when c_custkey % 11 = 0 then 'N' else 'Y' end discretionary, c_mktsegment strategy from {customer} where c_custkey % 97 <> 0""",
}

#: Large tables that are dealt by a key before a table is made of them: its joins and groups, and what is made of it, go by that key, too.
DEALT = {"holdings": {"lineitem": "l_partkey"}}
#: Tables that grow and are looked up by a key: dealt by it like the lines, so that neither is sorted and none sent whole to every executor.
LOOKED_UP = {"prices": ["cusip_map"]}


def needed(text: str) -> list[str]:
    """Domain tables that a text names, each after those it is made of."""
    out: list[str] = []

    def add(t: str) -> None:
        for name in TABLES:
            if re.search(rf"\b{name}\b", t) and name not in out:
                if TABLES[name] is not t:
                    add(TABLES[name])
                    if name not in out:
                        out.append(name)

    add(text)
    return out


def oracle(text: str) -> str:
    """The checking SQL with the domain tables it names put before it."""
    tables = [f"{n} as materialized ({TABLES[n].format(**{x: x for x in (*BASE, *TABLES)})})" for n in needed(text)]
    text = text.strip()
    if not tables:
        return text
    return "with " + ",\n".join(tables) + ("\n" + text if not text.lower().startswith("with ") else ",\n" + text[5:])


class Testbed:
    """Tables of one directory as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made, self._kept = spark, sf_dir, {}, set()

    def __getattr__(self, name: str) -> DataFrame:
        made = self.__dict__["_made"]
        if name not in made:
            if name in TABLES:
                used = {x: getattr(self, x) for x in re.findall(r"\{(\w+)\}", TABLES[name])}
                used.update({x: used[x].repartition(key) for x, key in DEALT.get(name, {}).items()})
                used.update({x: used[x].hint("shuffle_hash") for x in LOOKED_UP.get(name, ())})
                made[name] = self.spark.sql(TABLES[name], **used)
            elif name in BASE:
                made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return made[name]

    def kept(self, name: str, make: Callable[[], DataFrame] | None = None) -> DataFrame:
        """A table that a query uses more than once: worked out once. Tables made of it afterwards use it, too."""
        if name not in self.__dict__["_kept"]:
            self.__dict__["_made"][name] = kept(make() if make else getattr(self, name))
            self.__dict__["_kept"].add(name)
        return self.__dict__["_made"][name]
