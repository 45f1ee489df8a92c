"""All quality figures of a labelled corpus from one count of label pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtlog.functions.binding import bind
from thoughtlog.operators import evaluation as ev

METRICS = ("precision", "recall", "f1")


def packed_counts(processed: DataFrame, gold: DataFrame, key: str = "persona") -> DataFrame:
    """One row with ``pairs``, an array of ``(expected, predicted, n)``: at most the square of the
    number of classes, and the only thing that is gathered of the corpus."""
    if key == "persona":
        counts = ev.persona_pair_counts(processed, gold)
    else:
        counts = ev.pair_counts(ev.valid_pairs(ev.attach_gold(processed, gold, key)))
    return counts.agg(F.array_sort(F.collect_list(F.struct("expected", "predicted", "n"))).alias("pairs"))


def _sum(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda total, row: total + value(row))


def _total(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda total, row: total + value(row))


def class_report(pairs: Column) -> Column:
    """Array of ``(label, precision, recall, f1, support)`` of a row's pairs, sorted by label."""
    labels = F.array_sort(F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(p["expected"], p["predicted"])))))

    def of_label(label: Column) -> Column:
        support = _sum(F.filter(pairs, lambda p: p["expected"] == label), lambda p: p["n"])
        predicted = _sum(F.filter(pairs, lambda p: p["predicted"] == label), lambda p: p["n"])
        both = F.filter(pairs, lambda p: (p["expected"] == label) & (p["predicted"] == label))
        sums = F.struct(support.alias("support"), predicted.alias("predicted"), _sum(both, lambda p: p["n"]).alias("hits"))
        return bind(
            sums,
            lambda s: F.struct(
                label.alias("label"),
                ev.ratio(s["hits"], s["predicted"]).alias("precision"),
                ev.ratio(s["hits"], s["support"]).alias("recall"),
                ev.ratio(s["hits"] * 2, s["support"] + s["predicted"]).alias("f1"),
                s["support"].alias("support"),
            ),
        )

    return F.transform(labels, of_label)


def evaluate(processed: DataFrame, gold: DataFrame, key: str = "persona") -> dict[str, DataFrame]:
    """Metric tables by name. Every table derives from one row of counted pairs; no job runs and
    nothing is stored while they are built. ``gold`` holds ``expected`` per persona or, with
    ``key='entry_id'``, per entry."""
    packed = packed_counts(processed, gold, key)
    counts = packed.select(F.inline("pairs"))
    report = packed.select(F.inline(class_report(F.col("pairs"))))
    normalized = ev.confusion_normalized(ev.confusion_matrix(counts))
    return {
        "counts": counts,
        "accuracy": ev.accuracy(counts),
        "report": report,
        "macro": ev.macro_metrics(report),
        "weighted": ev.weighted_metrics(report),
        "matrix": ev.matrix_cells(normalized),
        "canonical_matrix": ev.canonical_matrix(counts),
        "bars": ev.class_metric_bars(report),
        "links": ev.flow_links(counts),
    }


def summary_of(pairs: Column) -> Column:
    """Array of ``(scope, label, metric, value)``: all metrics of a row's pairs."""

    def row(scope: str, label: Column, metric: str, value: Column) -> Column:
        return F.struct(F.lit(scope).alias("scope"), label.alias("label"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))

    def of_report(report: Column) -> Column:
        every = F.lit("all")
        hits = _sum(F.filter(pairs, lambda p: p["expected"] == p["predicted"]), lambda p: p["n"])
        support = _total(report, lambda r: r["support"])
        means = [row("macro", every, m, F.try_divide(_total(report, lambda r, m=m: r[m]), F.size(report))) for m in METRICS]
        weighted = [row("weighted", every, m, ev.ratio(_total(report, lambda r, m=m: r[m] * r["support"]), support)) for m in METRICS]
        classes = F.flatten(F.transform(report, lambda r: F.array(*[row("class", r["label"], m, r[m]) for m in (*METRICS, "support")])))
        overall = row("overall", every, "accuracy", ev.ratio(hits, _sum(pairs, lambda p: p["n"])))
        return F.concat(F.array(overall, *means, *weighted), classes)

    return bind(class_report(pairs), of_report)


def evaluation_summary(
    processed: DataFrame, gold: DataFrame, key: str = "persona"
) -> DataFrame:
    """``scope, label, metric, value``: overall, macro, weighted and per-class metrics, all from
    one row of counted pairs."""
    return packed_counts(processed, gold, key).select(F.inline(summary_of(F.col("pairs"))))
