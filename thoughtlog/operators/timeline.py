"""Views of processed entries per persona: calendar, series, shares and frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtlog.functions.calendar import day_of_week, week_no
from thoughtlog.functions.scores import polarity_value
from thoughtlog.functions.text import card_text, percent_text, translate_label
from thoughtlog.operators.numbering import day_number
from thoughtlog.schemas import NO_EMOTION

_CARDS = ("situations", "emotions", "thoughts", "reactions")


def with_calendar(numbered: DataFrame) -> DataFrame:
    """Add ``week_no``, ``day_of_week`` and ``polarity_value`` to numbered entries."""
    return numbered.withColumns(
        {
            "week_no": week_no(F.col("day_no")),
            "day_of_week": day_of_week(F.col("day_no")),
            "polarity_value": polarity_value(F.col("polarity")),
        }
    )


def persona_slice(processed: DataFrame, persona: str) -> DataFrame:
    """Entries of one persona with day number, calendar and polarity value."""
    return with_calendar(day_number(processed.where(F.col("persona") == persona)))


def persona_list(df: DataFrame) -> DataFrame:
    """``persona``: distinct and sorted."""
    return df.select("persona").distinct().orderBy("persona")


def emotion_frequency(processed: DataFrame, ordered: bool = True) -> DataFrame:
    """``persona, emotion, n``, most frequent first if ordered; records without emotions count
    nothing."""
    found = processed.where(F.col("emotions") != NO_EMOTION)
    emotions = found.select("persona", F.explode(F.split("emotions", ", ")).alias("emotion"))
    counts = emotions.groupBy("persona", "emotion").agg(F.count("*").alias("n"))
    return counts.orderBy("persona", F.desc("n"), "emotion") if ordered else counts


def polarity_summary(processed: DataFrame) -> DataFrame:
    """Per persona: entries, entries of each label, their shares, and the shares as text.

    Entries without a label count in the total only.
    """

    def count(label: str) -> Column:
        return F.count_if(F.col("polarity") == label)

    counts = processed.groupBy("persona").agg(
        F.count("*").alias("total"),
        count("POSITIVE").alias("n_positive"),
        count("NEGATIVE").alias("n_negative"),
        count("NEUTRAL").alias("n_neutral"),
    )
    return _with_shares(counts)


def polarity_counts(processed: DataFrame) -> DataFrame:
    """``persona, polarity, n``: counts that can be added to those of other entries."""
    return processed.groupBy("persona", "polarity").agg(F.count("*").alias("n"))


def summary_of_counts(counts: DataFrame) -> DataFrame:
    """As :func:`polarity_summary`, from ``persona, polarity, n`` in any number of parts."""

    def count(label: str) -> Column:
        return F.sum(F.when(F.col("polarity") == label, F.col("n")).otherwise(0))

    sums = counts.groupBy("persona").agg(
        F.sum("n").alias("total"),
        count("POSITIVE").alias("n_positive"),
        count("NEGATIVE").alias("n_negative"),
        count("NEUTRAL").alias("n_neutral"),
    )
    return _with_shares(sums)


def _with_shares(counts: DataFrame) -> DataFrame:
    names = ("positive", "negative", "neutral")
    shares = {f"share_{n}": F.col(f"n_{n}") / F.col("total") for n in names}
    texts = {f"text_{n}": percent_text(F.col(f"share_{n}")) for n in names}
    return counts.withColumns(shares).withColumns(texts)


def mood_heatmap(calendar: DataFrame) -> DataFrame:
    """``persona, week_no`` and the polarity value of each day of the week, ``d1`` to ``d7``."""
    days = [
        F.max(F.when(F.col("day_of_week") == d, F.col("polarity_value"))).alias(f"d{d}")
        for d in range(1, 8)
    ]
    numbered = calendar.where(F.col("day_no").isNotNull())
    return numbered.groupBy("persona", "week_no").agg(*days)


def polarity_series(calendar: DataFrame, ordered: bool = True) -> DataFrame:
    """``persona, day_no, polarity, polarity_name, polarity_value``, in day order if ordered."""
    series = calendar.select(
        "persona",
        "day_no",
        "polarity",
        translate_label(F.col("polarity")).alias("polarity_name"),
        "polarity_value",
    )
    return series.orderBy("persona", "day_no") if ordered else series


def record_for_day(processed: DataFrame, day: int, persona: str | None = None) -> DataFrame:
    """The record of one monitored day, of one persona or of every persona.

    Only ids are numbered and shuffled. The ids of the day are one per persona; whether they are
    sent to the wide records or shuffled with them is decided by their size when they are known.
    """
    if persona is not None:
        processed = processed.where(F.col("persona") == persona)
    days = day_number(processed.select("entry_id", "persona"))
    wanted = days.where(F.col("day_no") == day).drop("persona")
    return processed.join(wanted, "entry_id").select(
        "persona",
        "day_no",
        "polarity",
        "time_anchor",
        *[card_text(F.col(name)).alias(name) for name in _CARDS],
        "text",
    )
