"""All pairs of managers: blocks of matrices against the plain join, and how little leaves a task."""

import datetime as dt

import __spark_entry__ as entry
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterdeck.operators import research, risk


def _series(spark, managers=23, months=40):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(managers):
        for m in range(months):
            if rng.random() < 0.8:
                v = 0.1 if s == 3 else (0.3 if m < 35 else -2.0) if s == 5 else float(rng.normal(1e3 if s == 7 else 0, 1))
                rows.append((s, dt.date(2000 + m // 12, m % 12 + 1, 1), None if rng.random() < 0.1 else v))
    return spark.createDataFrame(rows, "slug long, month date, u double")


def _joined(series):
    a, b = series.select(F.col("slug").alias("a"), "month", F.col("u").alias("x")), series.select(F.col("slug").alias("b"), "month", F.col("u").alias("z"))
    got = a.join(b, "month").groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_samp("x", "z").alias("v"), *[F.stddev_pop(F.when(F.col(o).isNotNull(), F.col(c))).alias(f"s{c}") for c, o in ("xz", "zx")], F.covar_pop("x", "z").alias("p")).withColumn("c", F.try_divide("p", F.col("sx") * F.col("sz"))).collect()
    same = lambda c: None if c is None or c != c else c
    return {(r.a, r.b): (r.n, same(r.v), same(r.c)) for r in got}


def _near(x, y):
    return (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9 * max(1, abs(y)))


def test_pairs_by_blocks_are_those_of_the_join(spark):
    series = _series(spark)
    want = _joined(series)
    for block in (1000, 5, 1):
        got = risk.record_pairs(series, "u", 24, block=block).collect()
        assert {(r.a, r.b) for r in got} == {k for k, v in want.items() if k[0] < k[1] and v[0] >= 24} and len(got) == len({(r.a, r.b) for r in got})
        assert all(r.n == want[r.a, r.b][0] and _near(r.covar, want[r.a, r.b][1]) and _near(r.corr, want[r.a, r.b][2]) for r in got)
    rows = research.covariance_rows(series).collect()
    assert {(r.a, r.b) for r in rows} == set(want) and len(rows) == len(want)
    assert all(_near(r.v, want[r.a, r.b][1] if r.a == r.b or want[r.a, r.b][1] is None else want[r.a, r.b][1] / 2) for r in rows)
    assert risk.record_pairs(series.limit(0), "u").count() == 0


def test_no_row_of_a_pair_and_month(spark):
    for df in (risk.pair_correlations(_series(spark)), research.covariance_rows(_series(spark))):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["r15_covariance", "r17_pair_correlations"])
def test_records_are_worked_out_once(spark, name):
    assert not [f for f in entry.queries()[name](spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]


def test_a_record_is_dealt_a_few_times(spark):
    assert risk.pair_blocks(60_000) == 12 and risk.pair_blocks(360_000) == 45 and [risk.pair_blocks(n) for n in (0, 900, 6000)] == [1, 1, 6]
    both = {(r.a, r.b): r.covar for r in risk.record_pairs(_series(spark), "u", diagonal=True, block=5, wanted=("covar",), both_orders=True).collect()}
    assert set(both) == set(_joined(_series(spark))) and all(_near(v, both[b, a]) for (a, b), v in both.items())
