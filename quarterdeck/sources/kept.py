"""Tables that are used more than once, written to the cluster's shared folder and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_place(spark: SparkSession, kind: str) -> str:
    """A folder of its own in spark.checkpoint.dir, which all executors see; only a session on one machine may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.gettempdir()).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df worked out once: what uses it reads Parquet of the columns it needs, and Spark knows its size."""
    place = shared_place(df.sparkSession, "kept")
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
