"""Batch rules in their streaming form, over the file source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_files(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """Rows of files that have not been read before; the query's checkpoint remembers them."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def ingest(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Everything that is there now, appended once, then stop; runs again without repeats."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def in_time(stream: DataFrame, delay: str = "60 days") -> DataFrame:
    """Filings known by their formation date; later ones than the watermark are dropped with their state."""
    return stream.withWatermark("filed", delay).where(F.col("filed") <= F.last_day(F.add_months("period", 2)).cast("timestamp"))


def tumbling(stream: DataFrame, time: str, length: str, value: str, delay: str = "1 day") -> DataFrame:
    """Number and sum by window of event time."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, length)).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


CHAIN = "account_id long, statement_id string, period_end date, broken boolean, gap_days int"


#: Groups that accounts share their state in, by a hash: a task works through a group's accounts at once.
STATES = 1 << 14


def _days(dates: pd.Series) -> np.ndarray:
    """Days since 1970; NONE where there is no date."""
    return np.array(dates.tolist(), "datetime64[D]").astype(np.int64)


NONE = np.iinfo(np.int64).min


def chain_check(stream: DataFrame, states: int = STATES) -> DataFrame:
    """Each statement's beginning against the ending before it, kept as state by account.

    stream(account_id, statement_id, period_start, period_end, beginning_value, ending_value). Statements of one batch are
    taken by period end; one that is older than the state, of the end of another (by statement_id) or without an end is
    compared with nothing. A state holds the last end and ending of each account of its group; those without an account
    are a group of their own.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(pdfs), ignore_index=True)
        known, ends, endings = (np.asarray(x, t) for x, t in zip(state.get if state.exists else ([], [], []), (np.int64, np.int64, float), strict=True))
        account = np.zeros(len(new), np.int64) if key[0] < 0 else new["account_id"].to_numpy(np.int64)
        end, start, begin = _days(new["period_end"]), _days(new["period_start"]), new["beginning_value"].to_numpy(float)
        at = np.minimum(np.searchsorted(known, account), max(len(known) - 1, 0))
        late = (known[at] == account) & (end <= ends[at]) if len(known) else np.zeros(len(new), bool)
        # the states' rows come before the batch's
        a, e, v = np.concatenate([known, account]), np.concatenate([ends, end]), np.concatenate([endings, new["ending_value"].to_numpy(float)])
        use = np.flatnonzero(np.concatenate([np.ones(len(known), bool), ~late & (end != NONE)]))
        names = np.array([""] * len(known) + new["statement_id"].fillna("").tolist(), dtype=object)[use]
        order = use[np.lexsort((np.argsort(np.argsort(names, kind="stable"), kind="stable"), e[use], a[use]))]
        head = order[np.append(True, (a[order][1:] != a[order][:-1]) | (e[order][1:] != e[order][:-1]))[: len(order)]]
        follows = np.flatnonzero(a[head][1:] == a[head][:-1]) if len(head) else np.zeros(0, np.int64)
        was, row = head[follows], head[follows + 1] - len(known)
        gap, there, broken, checked = np.zeros(len(new), np.int64), np.zeros(len(new), bool), np.zeros(len(new), bool), np.zeros(len(new), bool)
        there[row] = start[row] != NONE
        gap[row] = np.where(there[row], start[row] - e[was] - 1, 0)
        checked[row] = there[row] & (gap[row] == 0) & ~np.isnan(begin[row]) & ~np.isnan(v[was])
        with np.errstate(invalid="ignore"):
            broken[row] = np.abs(begin[row] - v[was]) > np.maximum(1.0, 1e-4 * np.maximum(np.abs(begin[row]), np.abs(v[was])))
        last = head[np.append(a[head][1:] != a[head][:-1], True)[: len(head)]]
        state.update((a[last].tolist(), e[last].tolist(), v[last].tolist()))
        yield pd.DataFrame({
            "account_id": new["account_id"], "statement_id": new["statement_id"], "period_end": new["period_end"],
            "broken": pd.arrays.BooleanArray(broken, ~checked), "gap_days": pd.arrays.IntegerArray(gap.astype(np.int32), ~there),
        })

    group = F.when(F.col("account_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("account_id"), F.lit(states)).cast("int"))
    return stream.withColumn("group", group).groupBy("group").applyInPandasWithState(step, CHAIN, "accounts array<long>, ends array<long>, endings array<double>", "append", GroupStateTimeout.NoTimeout)


def latest_positions(stream: DataFrame, months: int = 4) -> DataFrame:
    """Each manager's newest filing and the day after which it no longer counts."""
    newest = stream.groupBy("slug").agg(F.max("filed").alias("filed"))
    return newest.withColumn("expires", F.last_day(F.add_months(F.to_date("filed"), months)))


def run_to_files(stream: DataFrame, mode: str, place: str) -> DataFrame:
    """Everything that is there now, as Parquet in place, a folder that all executors share; nothing meets on the driver.

    Each batch has a folder of its own, so one that is run again replaces itself; a complete result replaces the last.
    """
    spark, out = stream.sparkSession, f"{place}/out"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    put(spark.createDataFrame([], stream.schema), 0)
    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)
