"""Running numbers that do not gather a large group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: Raised where the pieces of the numbered rows and those that were counted are not the same.
MOVED = "rows were dealt out twice in different ways; numbers cannot be given"


def _hashed(df: DataFrame) -> Column:
    """A hash of all columns; maps are taken as lists of their entries."""
    kinds = [(f.name, isinstance(f.dataType, MapType)) for f in df.schema]
    return F.xxhash64(*[F.map_entries(f"`{n}`") if is_map else F.col(f"`{n}`") for n, is_map in kinds])


def _local(at: Column) -> Column:
    """Number of the partition in a value of ``monotonically_increasing_id``."""
    return F.shiftright(at, 33)


def running_number(
    df: DataFrame, name: str, order: str | Sequence[str], by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Number the rows of each group from 1 in the order of one or more keys of any orderable type.

    The rows are exchanged once, by ranges of (group, keys), and sorted where they then lie. A pass
    over them counts what every piece has of each group; the running sum of these counts, which has
    a row per group and one more per piece, is added to the places inside the pieces. Both passes
    read the same exchange, and rows that would get a number from another one raise. No job runs
    while the plan is built, and its size does not depend on the number of ranges.

    Rows with equal keys are numbered in the order of a hash of all their columns, which also
    lets the ranges cut between them, so any run gives the same numbers; only a row that
    is there several times with all its values stays in one piece. Rows with a null key get no
    number and do not count; rows of a null group get none either. There are as many ranges as
    shuffle partitions unless given. The rows are shuffled, so number slim rows before wide ones
    are made.
    """
    keys = [order] if isinstance(order, str) else list(order)
    if ranges is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorting = [*[F.col(c) for c in by], *[F.col(k).asc_nulls_last() for k in keys], _hashed(df)]
    placed = df.repartitionByRange(ranges, *sorting).sortWithinPartitions(*sorting)
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_piece", _local(F.col("_at")))
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    # the hash of all columns keeps the exchange below this pass the same as that of the rows
    counts = placed.groupBy("_piece", *by).agg(
        F.min("_at").alias("_first"), F.count_if(known).alias("_n"), F.bit_xor(_hashed(df)).alias("_seen")
    )
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    offsets = counts.select("_piece", *by, "_first", "_n", "_seen", before)
    grouped = known
    for column in by:
        grouped = grouped & F.col(column).isNotNull()
    inside = F.col("_at") - F.col("_first")
    sound = F.col("_seen").isNotNull() & (inside >= 0) & (inside < F.col("_n"))
    number = F.when(grouped, F.when(F.coalesce(sound, F.lit(False)), F.col("_before") + inside + 1).otherwise(F.raise_error(F.lit(MOVED)).cast("long")))
    return placed.join(offsets, ["_piece", *by], "left").select(*[F.col(f"`{c}`") for c in df.columns], number.alias(name))


def day_number(entries: DataFrame, order: str = "entry_id") -> DataFrame:
    """Add ``day_no``, the running number of an entry among those of its persona."""
    return running_number(entries, "day_no", order, ["persona"])


def assign_ids(rows: DataFrame, order: str = "grid_no") -> DataFrame:
    """Gapless ``entry_id`` over the rows whose text could be made, in planned order.

    Rows with a null text failed and get no id.
    """
    return running_number(rows.where(F.col("text").isNotNull()), "entry_id", order)
