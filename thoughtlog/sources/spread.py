"""Use all cores on inputs of few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


#: Bytes of stored texts whose tokens a task groups by sentence in memory.
PART_BYTES = 4 << 20


def parts(df: DataFrame) -> int:
    """Number of parts for work that groups the tokens of the texts: by the size of the table as the
    optimizer knows it, and as many as there are cores at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(df.sparkSession.sparkContext.defaultParallelism, min(size // PART_BYTES, 1 << 16))


def spread_if_few(df: DataFrame, key: str) -> DataFrame:
    """Spread the rows by key if the scan has fewer splits than the session has cores.

    Large inputs have many splits and stay where they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
