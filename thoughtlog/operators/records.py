"""Fields of thought records, gathered per entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtlog.functions.text import default_when_empty, ordered_distinct
from thoughtlog.operators.clauses import clauses
from thoughtlog.operators.tokens import (
    person_place_entities,
    sentence_texts,
    situation_sentences,
)
from thoughtlog.schemas import NO_REACTION, NO_SITUATION, NO_THOUGHT, NO_TRIGGER
from thoughtlog.sources.lexicons import PORTUGUESE, Lexicon

# Kind of a finding: the field it fills, its separator and what an empty field shows.
FIELDS = {
    "situation": ("situations", " | ", NO_SITUATION),
    "thought": ("thoughts", " | ", NO_THOUGHT),
    "reaction": ("reactions", " | ", NO_REACTION),
    "trigger": ("triggers", ", ", NO_TRIGGER),
}


def situation_findings(tokens: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """``entry_id, kind, ord, value``: sentences with a context noun, a person or a place.

    The sentences are found first, from few tokens; only their tokens are put together.
    """
    wanted = situation_sentences(tokens, lexicon)
    texts = sentence_texts(tokens.join(wanted, ["entry_id", "sent_no"], "left_semi"))
    return as_situations(texts, F.col("sentence"))


def as_situations(sentences: DataFrame, text: Column) -> DataFrame:
    """Sentence rows as findings."""
    return sentences.select(
        "entry_id",
        F.lit("situation").alias("kind"),
        F.col("sent_no").cast("long").alias("ord"),
        text.alias("value"),
    )


def trigger_findings(tokens: DataFrame) -> DataFrame:
    """``entry_id, kind, ord, value``: the people and places themselves."""
    return person_place_entities(tokens).select(
        "entry_id",
        F.lit("trigger").alias("kind"),
        F.col("first_tok").cast("long").alias("ord"),
        F.col("entity").alias("value"),
    )


def gather(kind: str) -> Column:
    """Aggregate: values of one kind by ``ord``, repeats dropped, as an array."""
    pairs = F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "value")))
    return ordered_distinct(pairs)


def field_text(kind: str, values: Column) -> Column:
    """Joined form of the values of a kind, with the text for an empty field."""
    _, separator, default = FIELDS[kind]
    return default_when_empty(values, separator, default)


def record_field(findings: DataFrame, kind: str) -> DataFrame:
    """``entry_id`` and the joined field of one kind, for entries that have findings."""
    name = FIELDS[kind][0]
    return (
        findings.where(F.col("kind") == kind)
        .groupBy("entry_id")
        .agg(field_text(kind, gather(kind)).alias(name))
    )


def situations(tokens: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """``entry_id, situations`` of the entries that have any."""
    return record_field(situation_findings(tokens, lexicon), "situation")


def triggers(tokens: DataFrame) -> DataFrame:
    """``entry_id, triggers`` of the entries that have any."""
    return record_field(trigger_findings(tokens), "trigger")


def thoughts(tokens: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """``entry_id, thoughts`` of the entries that have any."""
    return record_field(clauses(tokens, lexicon, "thought"), "thought")


def reactions(tokens: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """``entry_id, reactions`` of the entries that have any."""
    return record_field(clauses(tokens, lexicon, "reaction"), "reaction")
