"""Predicted against expected labels: pairs, confusion matrix, and metrics.

Everything after :func:`pair_counts` works on one row per pair of labels, so the pairs are
read and shuffled once, as partial counts.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtlog.functions.text import matrix_cell_text, translate_label
from thoughtlog.schemas import CLASSES, OLD_POLARITY_COLUMN
from thoughtlog.sources.sizes import literal_table

_METRICS = ("precision", "recall", "f1")


def prediction_column(df: DataFrame) -> str:
    """Name of the label column: the present one, or that of older files."""
    if "polarity" not in df.columns and OLD_POLARITY_COLUMN in df.columns:
        return OLD_POLARITY_COLUMN
    return "polarity"


def attach_gold(df: DataFrame, gold: DataFrame, key: str = "persona") -> DataFrame:
    """Add ``expected`` by persona or, with ``key='entry_id'``, by entry; null if unknown.

    ``gold`` must have one row per key. A literal or stored table carries its size, so the
    optimizer sends a small one to every task and shuffles a large one.
    """
    return df.join(gold.select(key, "expected"), key, "left")


def unknown_personas(df: DataFrame, gold: DataFrame) -> DataFrame:
    """``persona, n_entries`` of the personas without an expected label, null included.

    Entries are counted per persona before the join, so a large persona is one row there.
    """
    counts = df.groupBy("persona").agg(F.count("*").alias("n_entries"))
    return counts.join(gold.select("persona"), "persona", "left_anti")


def _complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without nulls in the columns. Unlike ``dropna``, a plain condition vanishes
    from the plan where a column cannot be null, instead of computing it a second time."""
    for column in columns:
        df = df.where(F.col(column).isNotNull())
    return df


def valid_pairs(df: DataFrame) -> DataFrame:
    """``expected, predicted`` of the rows that have both."""
    predicted = F.col(prediction_column(df)).alias("predicted")
    return _complete(df.select("expected", predicted), "expected", "predicted")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``expected, predicted, n``."""
    return pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def persona_pair_counts(processed: DataFrame, gold: DataFrame) -> DataFrame:
    """As :func:`pair_counts` with an expected label per persona.

    Entries are counted per persona and label first; only those counts meet the gold table.
    """
    predicted = F.col(prediction_column(processed)).alias("predicted")
    counts = (
        _complete(processed.select("persona", predicted), "persona", "predicted")
        .groupBy("persona", "predicted")
        .agg(F.count("*").alias("n"))
    )
    return (
        counts.join(_complete(gold, "persona", "expected"), "persona")
        .groupBy("expected", "predicted")
        .agg(F.sum("n").alias("n"))
    )


def label_union(counts: DataFrame) -> DataFrame:
    """``label``: the labels that were expected or predicted, sorted."""
    labels = counts.select(F.col("expected").alias("label")).union(counts.select("predicted"))
    return labels.distinct().orderBy("label")


def present_classes(counts: DataFrame, canonical: Sequence[str] = CLASSES) -> DataFrame:
    """``place, label``: the canonical labels that occur, in canonical order."""
    rows = list(enumerate(canonical))
    table = literal_table(counts.sparkSession, rows, place=pa.int32(), label=pa.string())
    return table.join(label_union(counts), "label", "left_semi").select("place", "label")


def confusion_matrix(counts: DataFrame, classes: Sequence[str] | None = None) -> DataFrame:
    """``expected, predicted, n`` for every pair of classes, 0 where none was counted.

    The classes are the given ones or else all that occur, which are gathered from the
    counted pairs and square to the size of the result.
    """
    if classes is None:
        sets = counts.agg(
            F.array_union(F.collect_set("expected"), F.collect_set("predicted")).alias("c")
        )
    else:
        sets = counts.agg(F.array(*[F.lit(c) for c in classes]).alias("c"))
    cells = sets.select("c", F.explode("c").alias("expected")).select(
        "expected", F.explode("c").alias("predicted")
    )
    return cells.join(counts, ["expected", "predicted"], "left").select(
        "expected", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def canonical_matrix(counts: DataFrame, canonical: Sequence[str] = CLASSES) -> DataFrame:
    """``expected, predicted, n, row_no, col_no`` for every pair of the canonical labels that
    occur; labels outside the canon are in neither direction."""
    present = F.array_sort(F.collect_list(F.struct("place", "label")))
    rows = present_classes(counts, canonical).agg(present.alias("c"))
    rows = rows.select("c", F.explode("c").alias("row")).select("row", F.explode("c").alias("col"))
    cells = rows.select(
        F.col("row.label").alias("expected"),
        F.col("col.label").alias("predicted"),
        F.col("row.place").alias("row_no"),
        F.col("col.place").alias("col_no"),
    )
    return cells.join(counts, ["expected", "predicted"], "left").select(
        "expected", "predicted", F.coalesce("n", F.lit(0)).alias("n"), "row_no", "col_no"
    )


def ratio(part: Column, whole: Column) -> Column:
    """Quotient as a double, 0 where the divisor is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion_normalized(matrix: DataFrame) -> DataFrame:
    """Add ``share``, the part of the row total; a row without counts has shares of 0."""
    totals = matrix.groupBy("expected").agg(F.sum("n").alias("total"))
    return matrix.join(totals, "expected").select(
        "expected", "predicted", "n", ratio(F.col("n"), F.col("total")).alias("share")
    )


def matrix_cells(normalized: DataFrame) -> DataFrame:
    """Add display names of both labels and the text of each matrix cell."""
    return normalized.withColumns(
        {
            "expected_name": F.coalesce(translate_label(F.col("expected")), "expected"),
            "predicted_name": F.coalesce(translate_label(F.col("predicted")), "predicted"),
            "cell": matrix_cell_text(F.col("n"), F.col("share")),
        }
    )


def accuracy(counts: DataFrame) -> DataFrame:
    """``accuracy``: the share of pairs with equal labels."""
    hits = F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0))
    return counts.agg(ratio(hits, F.sum("n")).alias("accuracy"))


def per_class_report(counts: DataFrame) -> DataFrame:
    """``label, precision, recall, f1, support`` of every expected or predicted label."""
    hit = F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("expected").alias("label"),
            F.col("n").cast("long").alias("support"),
            zero.alias("predicted"),
            hit.cast("long").alias("hits"),
        ),
        F.struct(
            F.col("predicted").alias("label"),
            zero.alias("support"),
            F.col("n").cast("long").alias("predicted"),
            zero.alias("hits"),
        ),
    )
    totals = (
        counts.select(F.inline(sides))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    return totals.select(
        "label",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(F.col("hits") * 2, F.col("support") + F.col("predicted")).alias("f1"),
        "support",
    )


def macro_metrics(report: DataFrame) -> DataFrame:
    """``precision, recall, f1``: plain means over the classes of a report."""
    return report.agg(*[F.avg(m).alias(m) for m in _METRICS])


def weighted_metrics(report: DataFrame) -> DataFrame:
    """``precision, recall, f1``: means over the classes weighted by support."""
    support = F.col("support")
    return report.agg(*[ratio(F.sum(F.col(m) * support), F.sum(support)).alias(m) for m in _METRICS])


def class_metric_bars(report: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """``label, metric, value`` of the fixed classes; a class that is absent has zeros."""
    table = literal_table(report.sparkSession, [(c,) for c in classes], label=pa.string())
    known = table.join(report, "label", "left").fillna(0.0, subset=list(_METRICS))
    return known.unpivot(["label"], list(_METRICS), "metric", "value")


def flow_links(counts: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """``source, target, value, hit``: flow from expected to predicted labels as node ids.

    Expected classes are the first nodes, predicted ones follow. Pairs with a label outside
    the fixed classes are left out.
    """
    nodes = F.create_map(*[F.lit(part) for i, c in enumerate(classes) for part in (c, i)])
    links = counts.select(
        nodes[F.col("expected")].alias("source"),
        (nodes[F.col("predicted")] + len(classes)).alias("target"),
        F.col("n").alias("value"),
        (F.col("expected") == F.col("predicted")).alias("hit"),
    )
    return _complete(links, "source", "target")
