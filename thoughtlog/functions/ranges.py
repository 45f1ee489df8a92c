"""Ranges of a key with about equal numbers of rows, whatever the values of the key are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantile_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending values that cut an integer key into n ranges of about equal
    counts: one scan of one column, one number for each range to the driver."""
    if n < 2:
        return []
    shares = [i / n for i in range(1, n)]
    return sorted({int(x) for x in df.approxQuantile(key, shares, 0.25 / n)})


def place_among(key: Column, bounds: Sequence[int]) -> Column:
    """How many of the ascending bounds are below the key, 0 for null: a balanced tree of
    comparisons."""

    def tree(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(key > bounds[middle], tree(middle + 1, last)).otherwise(tree(first, middle))

    return tree(0, len(bounds))
