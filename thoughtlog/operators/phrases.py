"""Lexicon phrases in lemma sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thoughtlog.functions.binding import bind
from thoughtlog.functions.text import default_when_empty
from thoughtlog.schemas import NO_EMOTION
from thoughtlog.sources.lexicons import PORTUGUESE, Lexicon
from thoughtlog.sources.sizes import literal_table


def lemmatised(
    spark: SparkSession, lexicon: Lexicon, annotator: Callable[[DataFrame], DataFrame]
) -> Lexicon:
    """The lexicon with its phrases as the lemmas that the user's annotator gives them.

    ``annotator`` makes a token table of ``entry_id, text`` (for example
    :func:`thoughtlog.operators.tokens.annotate` with a Python annotator). Phrases are compared
    with lemmas, so they must be lemmatised like the texts. A phrase is one row; their tokens
    are collected, a few dozen rows. A phrase without tokens keeps its words.
    """
    phrases = lexicon.phrases()
    entries = literal_table(
        spark,
        [(no, " ".join(lemmas)) for no, _, lemmas in phrases],
        entry_id=pa.int64(),
        text=pa.string(),
    )
    tokens = annotator(entries).select("entry_id", "tok_no", "lemma").collect()
    found: dict[int, list[str]] = {}
    for row in sorted(tokens, key=lambda r: (r.entry_id, r.tok_no)):
        found.setdefault(row.entry_id, []).append(row.lemma)
    categories: dict[str, list[list[str]]] = {c: [] for c in lexicon.emotion_phrases}
    for no, category, lemmas in phrases:
        categories[category].append(found.get(no, lemmas))
    return replace(lexicon, emotion_phrases=categories)


def phrase_places(lexicon: Lexicon) -> list[tuple[int, str, int, int, str]]:
    """(phrase_no, category, n_lemmas, place, lemma) of every place of every phrase."""
    return [
        (phrase_no, category, len(lemmas), place, lemma)
        for phrase_no, category, lemmas in lexicon.phrases()
        for place, lemma in enumerate(lemmas)
    ]


def vote_in_place(places: list[tuple[int, str, int, int, str]]) -> Callable:
    """Votes for phrase starts among the neighbours that lie together in a batch of tokens.

    A stretch is a run of rows of one entry with token numbers that follow one another. Every
    token that equals a lemma of a phrase votes for the start of the phrase. A start stays if
    every place of its phrase that falls into the stretch has voted: a whole phrase, or one that
    the ends of the stretch cut off. A word that starts or continues nothing is gone.
    """
    lemmas = sorted({lemma for *_, lemma in places})
    number = {lemma: i for i, lemma in enumerate(lemmas)}
    order = sorted(range(len(places)), key=lambda i: number[places[i][4]])
    which = np.array([number[places[i][4]] for i in order], np.int64)
    phrase, n_lemmas, place = (np.array([places[i][k] for i in order], np.int64) for k in (0, 2, 3))
    category = {p[0]: p[1] for p in places}
    first = np.searchsorted(which, np.arange(len(lemmas) + 1))
    names = ["entry_id", "phrase_no", "category", "n_lemmas", "start_tok", "votes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(lemmas, pa.string())
        for batch in batches:
            found = pc.index_in(batch.column("lemma").cast(pa.string()), wanted)
            at = np.flatnonzero(found.is_valid().to_numpy(False))
            if not len(at):
                continue
            lemma = found.drop_null().to_numpy().astype(np.int64)
            entry = pc.dictionary_encode(batch.column("entry_id"), null_encoding="encode").indices.to_numpy(False)
            tok = batch.column("tok_no").fill_null(-(2**30)).to_numpy(False).astype(np.int64)
            breaks = np.concatenate([[True], (entry[1:] != entry[:-1]) | (tok[1:] != tok[:-1] + 1)])
            stretch = np.cumsum(breaks) - 1
            begins = np.flatnonzero(breaks)
            ends = np.concatenate([begins[1:], [len(tok)]]) - 1
            times = first[lemma + 1] - first[lemma]
            row = np.repeat(at, times)
            entry_of = np.repeat(first[lemma] - (np.cumsum(times) - times), times) + np.arange(len(row))
            start = tok[row] - place[entry_of]
            sort = np.lexsort((start, phrase[entry_of], stretch[row]))
            row, entry_of, start = row[sort], entry_of[sort], start[sort]
            keys = np.stack([stretch[row], phrase[entry_of], start])
            head = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            votes = np.diff(np.concatenate([head, [len(row)]]))
            row, entry_of, start = row[head], entry_of[head], start[head]
            low, high = tok[begins[stretch[row]]], tok[ends[stretch[row]]]
            inside = np.minimum(high + 1, start + n_lemmas[entry_of]) - np.maximum(low, start)
            kept = votes == inside
            numbers = phrase[entry_of][kept]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("entry_id").take(pa.array(row[kept])),
                    pa.array(numbers, pa.int32()),
                    pa.array([category[x] for x in numbers.tolist()], pa.string()),
                    pa.array(n_lemmas[entry_of][kept], pa.int32()),
                    pa.array(start[kept], pa.int32()),
                    pa.array(votes[kept], pa.int64()),
                ],
                names,
            )

    return run


def match_phrases(tokens: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """``entry_id, phrase_no, category, start_tok, end_tok`` of every phrase occurrence.

    Tokens are looked at where they lie, beside their neighbours there (:func:`vote_in_place`).
    Only starts of phrases that are whole, or cut off by the end of what lies together, leave
    their task; the votes for cut ones meet in a shuffle, so the matches do not depend on how the
    table is ordered or split. No entry is ever put together in one row. Case is exact, overlaps
    are all reported, and a match may cross a sentence border. ``end_tok`` is the token after
    the last one.
    """
    kind = tokens.schema["entry_id"].dataType.simpleString()
    schema = f"entry_id {kind}, phrase_no int, category string, n_lemmas int, start_tok int, votes bigint"
    votes = tokens.select("entry_id", "tok_no", "lemma").mapInArrow(vote_in_place(phrase_places(lexicon)), schema)
    counted = votes.groupBy("entry_id", "phrase_no", "category", "n_lemmas", "start_tok").agg(F.sum("votes").alias("votes"))
    return counted.where(F.col("votes") == F.col("n_lemmas")).select(
        "entry_id",
        "phrase_no",
        "category",
        "start_tok",
        (F.col("start_tok") + F.col("n_lemmas")).alias("end_tok"),
    )


def joined_parts(parts: Column) -> Column:
    """Categories of the phrases that an entry's ``(ord, value)`` parts put together."""

    def whole(part: Column) -> Column:
        n = F.size(F.filter(parts, lambda p: p == part))
        return n == F.split(part["value"], "/", 3)[0].cast("int")

    return F.transform(F.filter(F.array_distinct(parts), whole), lambda p: F.split(p["value"], "/", 3)[2])


def emotion_set(matches: DataFrame) -> DataFrame:
    """``entry_id, emotions``: distinct categories of an entry, sorted and joined.

    Only entries with a match have a row.
    """
    categories = F.array_sort(F.collect_set("category"))
    return matches.groupBy("entry_id").agg(
        default_when_empty(categories, ", ", NO_EMOTION).alias("emotions")
    )
