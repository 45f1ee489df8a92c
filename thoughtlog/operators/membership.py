"""Filters by word lists of any length."""

from __future__ import annotations

from collections.abc import Collection

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtlog.sources.sizes import literal_table

# Up to this many words the list is a literal set inside the filter expression.
LITERAL_WORDS = 2_000


def member(key: Column, words: Collection[str]) -> Column:
    """Whether the key is in the list, never null; a long list is a literal array's hash set."""
    return F.coalesce(key.isin(sorted(words)), F.lit(False)) if words else F.lit(False)


def _joined(df: DataFrame, key: Column, words: Collection[str], how: str) -> DataFrame:
    rows = [(word,) for word in sorted(words)]
    table = literal_table(df.sparkSession, rows, _word=pa.string())
    return df.join(table, key == F.col("_word"), how)


def keep_members(df: DataFrame, key: Column, words: Collection[str]) -> DataFrame:
    """Rows whose key is in the list."""
    if len(words) <= LITERAL_WORDS:
        return df.where(key.isin(sorted(words)))
    return _joined(df, key, words, "left_semi")


def drop_members(df: DataFrame, key: Column, words: Collection[str]) -> DataFrame:
    """Rows whose key is not in the list; a null key stays."""
    if len(words) <= LITERAL_WORDS:
        return df.where(~F.coalesce(key.isin(sorted(words)), F.lit(False)))
    return _joined(df, key, words, "left_anti")
