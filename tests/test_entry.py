import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
SOME = ["a03_filing_features", "k10_formation_weights", "k02_reconcile", "a07_variants", "w08_drawdowns", "r25_hac_mean", "j14_as_of", "s15_statement_fields", "k26_sector_exposure", "s24_sleeve_returns", "w14_home_weights", "a33_curves"]


def test_entry_has_rows(spark):
    assert entry.entry(spark).columns[:2] == ["slug", "period"]


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(v):
    return "" if v is None or v != v else f"{float(v) + 0.0:.6f}" if isinstance(v, (int, float)) else str(v)[:10] if hasattr(v, "year") else str(v)


@pytest.mark.parametrize("name", SOME)
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    got = entry.queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert sorted([plain(r[c]) for c in sorted(names)] for r in got.collect()) == sorted([plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)] for r in rows)
