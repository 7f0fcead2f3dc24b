"""Partitions of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task sorts at a time, on average.
ROWS = 500_000


def dealt(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """The frame hashed by the keys into partitions of ROWS rows on average, at least one a core: their number grows
    with the rows, so a task's memory doesn't. What follows by the same keys shuffles nothing again."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n_rows // ROWS)), *keys)
