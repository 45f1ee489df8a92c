"""Records, polarity and keywords of every entry, beside the entry."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtlog.functions.binding import bind
from thoughtlog.functions.text import default_when_empty, time_anchor
from thoughtlog.operators.findings import findings
from thoughtlog.operators.phrases import joined_parts
from thoughtlog.operators.records import FIELDS, field_text, gather
from thoughtlog.operators.scoring import ColumnScorer, Scorer, classify, polarity_column
from thoughtlog.schemas import NO_EMOTION, PROCESSED
from thoughtlog.sources.lexicons import PORTUGUESE, Lexicon

RECORD_FIELDS = (
    "time_anchor",
    "situations",
    "thoughts",
    "emotions",
    "reactions",
    "triggers",
)


def gather_fields(found: DataFrame) -> DataFrame:
    """One row per entry with an array per field; all kinds share one shuffle by entry."""
    emotion = F.when(F.col("kind") == "emotion", F.col("value"))
    part = F.when(F.col("kind") == "part", F.struct("ord", "value"))
    emotions = F.concat(F.collect_set(emotion), bind(F.collect_list(part), joined_parts))
    keyword = F.flatten(F.collect_list(F.when(F.col("kind") == "keyword", F.col("words"))))
    arrays = [gather(kind).alias(name) for kind, (name, _, _) in FIELDS.items()]
    return found.groupBy("entry_id").agg(
        *arrays,
        F.array_sort(F.array_distinct(emotions)).alias("emotions"),
        F.transform(F.sort_array(keyword), lambda p: p["value"]).alias("keywords"),
    )


def _texts() -> dict[str, Column]:
    texts = {name: field_text(kind, F.col(name)) for kind, (name, _, _) in FIELDS.items()}
    texts["emotions"] = default_when_empty(F.col("emotions"), ", ", NO_EMOTION)
    texts["keywords"] = default_when_empty(F.col("keywords"), " ", "")
    return texts


def _anchors(lexicon: Lexicon) -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    return time_anchor(text, lexicon.time_words).alias("time_anchor")


def extract_records(
    entries: DataFrame,
    tokens: DataFrame,
    lexicon: Lexicon = PORTUGUESE,
    arrays: bool = False,
) -> DataFrame:
    """``entry_id`` and the six record fields of every entry.

    ``arrays=True`` adds the lists behind the joined fields as ``<field>_list``.
    """
    fields = gather_fields(findings(tokens, lexicon)).drop("keywords")
    joined = entries.select("entry_id", _anchors(lexicon)).join(fields, "entry_id", "left")
    texts = _texts()
    columns = [
        F.col(name) if name == "time_anchor" else texts[name].alias(name)
        for name in RECORD_FIELDS
    ]
    if arrays:
        empty = F.array().cast("array<string>")
        columns += [
            F.coalesce(F.col(name), empty).alias(f"{name}_list") for name in RECORD_FIELDS[1:]
        ]
    return joined.select("entry_id", *columns)


def attach_results(entries: DataFrame, *results: DataFrame) -> DataFrame:
    """Put result tables beside their entries, by ``entry_id``."""
    for result in results:
        entries = entries.join(result, "entry_id", "left")
    return entries


def enrich(
    entries: DataFrame,
    tokens: DataFrame,
    ids: Column,
    scorer: Scorer,
    labels: Mapping[int, str],
    lexicon: Lexicon = PORTUGUESE,
) -> DataFrame:
    """The processed table: entries with record fields, polarity and keywords.

    ``ids`` gives the token ids of an entry from its columns. ``tokens`` is read once. Findings of all kinds are shuffled by entry once and
    meet the entries in one join. An expression scorer labels the entries where they lie.
    """
    found = findings(tokens, lexicon, keywords=True)
    base = entries.select(
        "entry_id",
        "persona",
        "text",
        _anchors(lexicon),
        F.coalesce(ids, F.array().cast("array<int>")).alias("ids"),
    )
    if isinstance(scorer, ColumnScorer):
        label = polarity_column(F.col("ids"), scorer, labels).alias("polarity")
        base = base.select("entry_id", "persona", "text", "time_anchor", label)
        labelled = attach_results(base, gather_fields(found))
    else:
        polarity = classify(base.select("entry_id", "ids"), scorer, labels)
        labelled = attach_results(base.drop("ids"), gather_fields(found), polarity)
    return labelled.withColumns(_texts()).select(PROCESSED.names)
