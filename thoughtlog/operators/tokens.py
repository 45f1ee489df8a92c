"""Sentences, rule tokens, and sentence-level findings on a token table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtlog.functions.text import strip
from thoughtlog.operators.membership import keep_members, member
from thoughtlog.schemas import TOKEN
from thoughtlog.sources.lexicons import PORTUGUESE, Lexicon

SENTENCE = r"[^.!?\n]+[.!?]*"
WORD = r"[\p{L}\p{N}]+"

# Entity labels that count as people and places.
PERSON_PLACE = ("PER", "LOC")


def words_of(text: Column) -> Column:
    """All word tokens of a text, as an array."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def sentences_of(text: Column) -> Column:
    """All rule sentences of a text, unstripped, as an array."""
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def split_sentences(entries: DataFrame) -> DataFrame:
    """``entry_id, sent_no, sentence`` by punctuation and line ends; no shuffle."""
    rows = entries.select("entry_id", F.posexplode(sentences_of(F.col("text"))))
    return rows.select(
        "entry_id", (F.col("pos") + 1).alias("sent_no"), strip(F.col("col")).alias("sentence")
    )


def rule_tokens(entries: DataFrame) -> DataFrame:
    """``entry_id, sent_no, tok_no, place, text``: words by rule, numbered in the entry
    (``tok_no``) and in the sentence (``place``), without a shuffle."""
    nested = F.transform(
        sentences_of(F.col("text")),
        lambda sentence, i: F.transform(
            words_of(sentence),
            lambda word, j: F.struct(
                (i + 1).alias("sent_no"), (j + 1).alias("place"), word.alias("text")
            ),
        ),
    )
    rows = entries.select("entry_id", F.posexplode(F.flatten(nested)))
    return rows.select(
        "entry_id",
        F.col("col.sent_no").alias("sent_no"),
        (F.col("pos") + 1).alias("tok_no"),
        F.col("col.place").alias("place"),
        F.col("col.text").alias("text"),
    )


def tokenize(entries: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Token table by rule, for operators that need words and lemmas only.

    ``lemmas`` is an optional table ``form, lemma`` with lower-case unique forms; a word
    without a row there is its own lemma, in lower case.
    """
    rows = rule_tokens(entries).withColumn("form", F.lower("text"))
    if lemmas is not None:
        rows = rows.join(lemmas.select("form", "lemma"), "form", "left")
    else:
        rows = rows.withColumn("lemma", F.lit(None).cast("string"))
    known = {
        "head": F.lit(0),
        "ws": F.lit(" "),
        "lemma": F.coalesce("lemma", "form"),
        "is_stop": F.lit(False),
    }
    return rows.select(
        [
            known.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in TOKEN
        ]
    )


def annotate(
    entries: DataFrame,
    annotator: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    partitions: int | None = None,
) -> DataFrame:
    """Token table from an annotator in Python, given for ``mapInPandas``.

    It gets frames of ``entry_id, text`` and gives frames in the shape of the token table. It
    should load its model once, before the first batch. Store the result: every text should
    be parsed once, however many operators read its tokens.
    """
    rows = entries.select("entry_id", F.coalesce("text", F.lit("")).alias("text"))
    if partitions is not None:
        rows = rows.repartition(partitions, "entry_id")
    return rows.mapInPandas(annotator, TOKEN)


def text_in_order(order: Column, piece: Column) -> Column:
    """Aggregate that concatenates text pieces by an explicit order."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("ord"), piece.alias("piece"))))
    return F.array_join(F.transform(pairs, lambda pair: pair["piece"]), "")


def _with_space() -> Column:
    return F.concat(F.col("text"), F.coalesce(F.col("ws"), F.lit("")))


def sentence_texts(tokens: DataFrame) -> DataFrame:
    """``entry_id, sent_no, sentence`` put together again from annotated tokens."""
    return tokens.groupBy("entry_id", "sent_no").agg(
        strip(text_in_order(F.col("tok_no"), _with_space())).alias("sentence")
    )


def context_sentences(tokens: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """``entry_id, sent_no`` of sentences with a context noun."""
    hits = keep_members(tokens, F.lower("lemma"), lexicon.context_nouns)
    return hits.select("entry_id", "sent_no").distinct()


def situation_sentences(tokens: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """``entry_id, sent_no`` of sentences with a context noun, a person or a place."""
    noun = member(F.lower("lemma"), lexicon.context_nouns)
    named = F.col("ent_label").isin(*PERSON_PLACE)
    return tokens.where(noun | F.coalesce(named, F.lit(False))).select("entry_id", "sent_no").distinct()


def person_place_entities(tokens: DataFrame) -> DataFrame:
    """``entry_id, sent_no, ent_id, first_tok, entity`` of people and places."""
    parts = tokens.where(F.col("ent_label").isin(*PERSON_PLACE))
    return parts.groupBy("entry_id", "sent_no", "ent_id").agg(
        F.min("tok_no").alias("first_tok"),
        strip(text_in_order(F.col("tok_no"), _with_space())).alias("entity"),
    )
