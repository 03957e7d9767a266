"""How a query is registered: a function of the testbed, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .testbed import Testbed, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Decimals of results: ratios, and money.
RATIO, MONEY = 6, 2


def query(name: str, sql: str | None = None):
    """Registers a function of Testbed; without sql the result is held against tests alone."""

    def put(f: Callable[[Testbed], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Testbed(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return put


def tidy(df: DataFrame, money: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded for comparison; a NaN becomes null, since none may be stored."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("double", "float"):
            c = F.round(F.when(~F.isnan(c), c), MONEY if f.name in money else RATIO)
        out.append(c.alias(f.name))
    return df.select(*out)
