"""Small tables whose size the optimizer knows."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def literal_table(
    spark: SparkSession, rows: Sequence[tuple], **columns: pa.DataType
) -> DataFrame:
    """Table of Python rows that the plan holds with its exact size.

    A join with it is then broadcast or shuffled by that size, without a hint.
    """
    values = list(zip(*rows)) or [()] * len(columns)
    arrays = [pa.array(v, kind) for v, kind in zip(values, columns.values())]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))
