"""A folder for intermediate tables that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder the session names in ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one machine, may go without the setting.
    """
    shared = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="burdenlens-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of a DataFrame as a table written below the shared folder.

    Cuts the lineage: later steps read the table again instead of computing it again, also after
    executors are lost.
    """
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, order: list[str | Column], purpose: str) -> DataFrame:
    """The rows dealt out by ranges of an order and sorted, as a stored table with ``part``, the number
    of the range, and ``place``, a number that grows within it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return stored(ranged.withColumns({"part": F.spark_partition_id(), "place": place}), purpose)
