"""Calendar expressions over a running day number that starts at 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_no(day_no: Column) -> Column:
    """Seven-day week of a day, from 1."""
    return (F.floor((day_no - 1) / 7) + 1).cast("int")


def day_of_week(day_no: Column) -> Column:
    """Place of a day in its week, 1 to 7."""
    return ((day_no - 1) % 7 + 1).cast("int")
