"""S19 at values where a cent hangs on the last bit: no order of lines may decide it."""

import datetime as dt

import __spark_entry__ as entry
import duckdb
import pandas as pd


def _lines(turned):
    rows = []
    for m in range(40):
        month, scale = dt.datetime(1995 + m // 12, m % 12 + 1, 9), 150 if m % 2 else 1
        prices = [round(x * scale, 2) for x in (0.1, 0.2, 0.3, 0.7, 1.1, 97.6)]
        rows += [(1, month, p, 1.0) for p in (prices[::-1] if turned else prices)]
    return pd.DataFrame(rows, columns=["l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"])


def test_no_order_of_lines_decides_a_cent(spark, tmp_path):
    got = []
    for turned in (False, True):
        place = tmp_path / str(turned)
        place.mkdir()
        lines = _lines(turned)
        lines.to_parquet(place / "lineitem.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        rows = entry.queries()["s19_series_to_statements"](spark, str(place)).collect()
        got.append({r.period_end: r.ending_value for r in rows})
        con = duckdb.connect()
        con.register("lineitem", lines)
        assert {r[1]: r[2] for r in con.execute(entry.oracle_sql()["s19_series_to_statements"]).fetchall()} == got[-1]
    assert got[0] == got[1] and len(got[0]) == 39 and max(got[0].values()) > 1e12
