"""Incremental index: reuse what didn't change, take anew what did, drop what is gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(cached: DataFrame, current: DataFrame, key: str = "source", stamp: str = "stamp") -> DataFrame:
    """Rows of ``current`` and of what is gone, with ``action``: reuse, replace, add or drop."""
    old = cached.select(key, F.col(stamp).alias("_old"), F.lit(True).alias("_had"))
    both = current.withColumn("_has", F.lit(True)).join(old, key, "full")
    action = (
        F.when(F.col("_has").isNull(), "drop").when(F.col("_had").isNull(), "add").when(F.col("_old") == F.col(stamp), "reuse").otherwise("replace")
    )
    return both.withColumn("action", action).drop("_old", "_had", "_has")
