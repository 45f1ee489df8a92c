"""Readers and writers for entries, processed entries and token annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thoughtlog.schemas import (
    CSV_COLUMNS,
    ENTRY,
    OLD_POLARITY_COLUMN,
    OLD_POLARITY_HEADER,
    PROCESSED,
    TOKEN,
)

# Quotes are doubled inside quoted fields, and spaces at the ends of a field are data.
_CSV = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
_CSV_READ_ONLY = {"multiLine"}
# Exchanged files start with a byte-order mark.
_MARK = "\ufeff"


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings under our names; columns are found by header, not place."""
    raw = spark.read.options(**_CSV).csv(path)
    names = {**CSV_COLUMNS, OLD_POLARITY_HEADER: OLD_POLARITY_COLUMN}
    bare = [name.removeprefix(_MARK) for name in raw.columns]
    return raw.toDF(*[names.get(name, name) for name in bare])


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw entries ``entry_id, persona, text``.

    A CSV file with line breaks inside fields cannot be split: convert a large corpus to
    parquet once with :func:`write_corpus`.
    """
    if fmt == "parquet":
        return spark.read.schema(ENTRY).parquet(path)
    rows = _read_csv(spark, path)
    return rows.select([F.col(field.name).cast(field.dataType) for field in ENTRY])


def read_processed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Processed entries. In CSV, empty fields come back as null, and a file from before the
    label column was renamed keeps that column under its own name."""
    if fmt == "parquet":
        return spark.read.schema(PROCESSED).parquet(path)
    rows = _read_csv(spark, path)
    fields = [
        F.col(field.name).cast(field.dataType)
        for field in PROCESSED
        if field.name in rows.columns
    ]
    if OLD_POLARITY_COLUMN in rows.columns:
        fields.append(F.col(OLD_POLARITY_COLUMN))
    return rows.select(fields)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Token annotations in the shape of :data:`thoughtlog.schemas.TOKEN`."""
    return spark.read.schema(TOKEN).parquet(path)


def _write(df: DataFrame, path: str, fmt: str, mode: str) -> None:
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
        return
    headers = {column: header for header, column in CSV_COLUMNS.items()}
    titles = [headers.get(c, c) for c in df.columns]
    named = df.toDF(_MARK + titles[0], *titles[1:])
    options = {k: v for k, v in _CSV.items() if k not in _CSV_READ_ONLY}
    named.write.mode(mode).options(**options).csv(path)


def write_corpus(
    entries: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Write raw entries as parquet, or as CSV with the exchanged headers."""
    _write(entries.select(ENTRY.names), path, fmt, mode)


def write_processed(
    processed: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Write processed entries as parquet, or as CSV with the exchanged headers and mark."""
    _write(processed.select(PROCESSED.names), path, fmt, mode)


def write_tokens(tokens: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write token annotations as parquet."""
    tokens.select(TOKEN.names).write.mode(mode).parquet(path)


def write_bucketed(
    df: DataFrame, table: str, buckets: int, mode: str = "errorifexists", dealt: bool = False, path: str | None = None
) -> None:
    """Save a table in buckets of ``entry_id``, sorted inside them.

    Entries and tokens saved with one number of buckets are joined and grouped by entry without
    a shuffle. The rows are brought to their buckets first, so that each bucket is one file;
    ``dealt`` says that they lie so already, as tokens do that were made where their texts had been
    brought by ``repartition(buckets, "entry_id")``. The files go to ``path``, if given.
    """
    rows = df if dealt else df.repartition(buckets, "entry_id")
    writer = rows.write.mode(mode).format("parquet").bucketBy(buckets, "entry_id").sortBy("entry_id")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """A table of :func:`write_bucketed`, with its buckets known to the optimizer."""
    return spark.table(table)
