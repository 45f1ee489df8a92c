"""Every view of every persona, keyed by persona."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thoughtlog.operators import timeline as tl
from thoughtlog.operators.keywords import TOP_TERMS, term_frequency, top_terms
from thoughtlog.operators.numbering import day_number


def persona_views(
    processed: DataFrame, k: int = TOP_TERMS, ordered: bool = True
) -> dict[str, DataFrame]:
    """View tables by name, for all personas at once. ``processed`` should be a stored
    table: each view reads only its columns. ``ordered`` sorts what is shown in an order."""
    slim = processed.select("entry_id", "persona", "polarity")
    calendar = tl.with_calendar(day_number(slim))
    return {
        "personas": tl.persona_list(processed),
        "summary": tl.polarity_summary(processed),
        "emotions": tl.emotion_frequency(processed, ordered),
        "heatmap": tl.mood_heatmap(calendar),
        "series": tl.polarity_series(calendar, ordered),
        "terms": top_terms(term_frequency(processed), k),
    }


def persona_view_rows(processed: DataFrame, k: int = TOP_TERMS) -> DataFrame:
    """``persona, view, item, value``: the numbers of all views as one long table."""
    return long_rows(persona_views(processed, k, ordered=False))


def long_rows(views: dict[str, DataFrame]) -> DataFrame:
    """View tables as one long table: ``persona, view, item, value``."""
    counts = ["total", "n_positive", "n_negative", "n_neutral"]
    summary = views["summary"].select("persona", *counts).unpivot(
        ["persona"], counts, "item", "value"
    )
    weeks = views["heatmap"].unpivot(
        ["persona", "week_no"], [f"d{d}" for d in range(1, 8)], "day", "value"
    )
    parts = {
        "summary": summary,
        "emotions": views["emotions"].select(
            "persona", F.col("emotion").alias("item"), F.col("n").alias("value")
        ),
        "heatmap": weeks.where(F.col("value").isNotNull()).select(
            "persona", F.concat_ws(" ", F.concat(F.lit("w"), "week_no"), "day").alias("item"), "value"
        ),
        "series": views["series"].select(
            "persona",
            F.col("day_no").cast("string").alias("item"),
            F.col("polarity_value").alias("value"),
        ),
        "terms": views["terms"].select(
            "persona", F.col("term").alias("item"), F.col("n").alias("value")
        ),
    }
    rows = [
        part.select(
            "persona",
            F.lit(view).alias("view"),
            "item",
            F.col("value").cast("long").alias("value"),
        )
        for view, part in parts.items()
    ]
    union = rows[0]
    for part in rows[1:]:
        union = union.unionByName(part)
    return union
