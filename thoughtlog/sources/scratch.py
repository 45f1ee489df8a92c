"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_LEFT: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """The given folder, else the one in ``spark.checkpoint.dir``, else the checkpoint folder of
    the context. Nothing is set and no machine-local folder is made: without any of the three
    the call is refused."""
    folder = folder or spark.conf.get(SETTING, None)
    if folder is None:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()  # the context's own subfolder
        folder = made.get() if made.isDefined() else None
    if folder is None:
        raise ValueError(f"set {SETTING}, or a checkpoint folder, to one all executors share")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A path in the shared folder that nothing else uses; removed when the driver ends."""
    path = f"{shared_folder(spark, folder)}/{name}-{uuid.uuid4().hex}"
    _LEFT.append((spark, path))
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, wherever its store is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table, wherever the shared folder is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage so that later work neither repeats the plan nor loses it with an
    executor, and gives the optimizer the real size of the table.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name, folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables of one job, removed together."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self.paths = spark, folder, []

    def store(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        path = fresh_path(self.spark, name, self.folder)
        self.paths.append(path)
        df.write.parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def store_bucketed(self, df: DataFrame, name: str, key: str, buckets: int, compression: str | None = None) -> DataFrame:
        """As :meth:`store`, with every task's rows in files by buckets of the key, so that rows of a
        key are found together without being shuffled. The table is known to this session only."""
        path = fresh_path(self.spark, name, self.folder)
        self.paths.append(path)
        table = f"{name}_{path[-32:]}"
        df.write.format("parquet").bucketBy(buckets, key).saveAsTable(table, path=path, compression=compression)
        return self.spark.table(table)

    def drop(self, path: str) -> None:
        remove(self.spark, path)
        self.paths.remove(path)

    def clear(self) -> None:
        for path in list(self.paths):
            self.drop(path)


@contextmanager
def scratch(spark: SparkSession, folder: str | None = None) -> Iterator[Scratch]:
    """Tables stored inside the block are removed at its end; write the result before."""
    tables = Scratch(spark, folder)
    try:
        yield tables
    finally:
        tables.clear()


@atexit.register
def _clear_left() -> None:
    for spark, path in _LEFT:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be over
            return
