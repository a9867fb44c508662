"""Enough tasks for stages whose cost is computation, not reading."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """``df`` in at least ``per_core`` partitions a core; a table that is split finely enough is left as it is."""
    wanted = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
