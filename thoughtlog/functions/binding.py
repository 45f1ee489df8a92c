"""Evaluate an expression once and use the value several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    Column aliases do not promise that: when a filter is pushed below a projection, the
    expression behind an alias is copied to every place that mentions it, also into the
    bodies of array functions, where it would run once per element.
    """
    return F.transform(F.array(value), use)[0]
