"""A rule-made stand-in for an annotator, a scorer and word lists.

The rules follow word lengths and places, so they find work in invented texts of any
language. They are test doubles: the labels mean nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtlog.functions.scores import score_array
from thoughtlog.operators.scoring import BatchScorer, ColumnScorer
from thoughtlog.operators.tokens import rule_tokens, words_of
from thoughtlog.schemas import TOKEN
from thoughtlog.sources.lexicons import Lexicon

LEXICON = Lexicon(
    time_words=("the", "with", "this", "that"),
    context_nouns=frozenset({"anea", "than", "then"}),
    cognitive_verbs=frozenset({"that", "this"}),
    action_verbs=frozenset({"with", "from"}),
    stopwords=frozenset({"tion", "ther", "thon"}),
    emotion_phrases={
        "alpha": ("the and",),
        "beta": ("thanedble the anea",),
        "gamma": ("that the", "for the"),
        "delta": ("with the",),
    },
)

LABELS = {0: "NEGATIVE", 1: "NEUTRAL", 2: "POSITIVE"}

GOLD = {f"src{i}": label for i, label in enumerate(
    ["POSITIVE"] * 5 + ["NEGATIVE"] * 5 + ["NEUTRAL"] * 5
)}

_POS = ("NOUN", "VERB", "ADJ", "ADV", "AUX")
_DEP = ("ccomp", "xcomp", "obl", "nsubj")


def _choose(number: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), number + 1)


def annotate(entries: DataFrame) -> DataFrame:
    """Token table of ``entry_id, text`` by fixed rules; a narrow step."""
    rows = rule_tokens(entries)
    place, tok_no = F.col("place"), F.col("tok_no")
    half = F.shiftright(place, 1)
    initial = F.substring("text", 1, 1)
    named = (initial != F.lower(initial)) & (place > 1)
    made = {
        "head": F.when(half > 0, tok_no - place + half).otherwise(0),
        "ws": F.lit(" "),
        "lemma": F.lower("text"),
        "pos": _choose(F.length("text") % 5, _POS),
        "dep": _choose(place % 4, _DEP),
        "ent_id": F.when(named, tok_no),
        "ent_label": F.when(named, F.lit("PER")),
        "is_stop": F.lit(False),
    }
    return rows.select(
        [made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in TOKEN]
    )


def batch_annotator() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The same tokens from Python, as an annotator for ``mapInPandas``. The functions are
    nested so that they travel to the workers by value."""
    names = TOKEN.names
    tags, relations = _POS, _DEP

    def frame(entry_ids: list, n_sentences: list[int], sentences: list[list[str]]) -> pd.DataFrame:
        import numpy as np

        def counted(sizes: np.ndarray) -> np.ndarray:
            return np.arange(1, sizes.sum() + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)

        words = [word for sentence in sentences for word in sentence]
        sizes = np.array([len(sentence) for sentence in sentences], np.int64)
        of_entry = np.repeat(np.arange(len(entry_ids)), n_sentences)
        n_words = np.bincount(of_entry, sizes, len(entry_ids)).astype(np.int64)
        place, tok_no = counted(sizes), counted(n_words)
        named = (place > 1) & np.array([word[0] != word[0].lower() for word in words], bool)
        length = np.fromiter(map(len, words), np.int64, len(words))
        columns = (
            pd.Series(entry_ids).repeat(n_words).to_numpy(),
            np.repeat(counted(np.array(n_sentences, np.int64)), sizes),
            tok_no,
            np.where(place > 1, tok_no - place + place // 2, 0),
            words,
            " ",
            [word.lower() for word in words],
            np.array(tags, object)[length % 5],
            np.array(relations, object)[place % 4],
            pd.arrays.IntegerArray(tok_no.astype(np.int32), ~named),
            np.where(named, "PER", None),
            False,
        )
        return pd.DataFrame(dict(zip(names, columns)))

    def annotate_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        sentence, word = regex.compile(r"[^.!?\n]+[.!?]*"), regex.compile(r"[\p{L}\p{N}]+")
        for batch in batches:
            entry_ids, n_sentences, sentences, n_words = [], [], [], 0
            for entry_id, text in zip(batch["entry_id"], batch["text"]):
                found = [word.findall(part) for part in sentence.findall(text)]
                entry_ids.append(entry_id)
                n_sentences.append(len(found))
                sentences += found
                n_words += sum(map(len, found))
                if n_words > 50_000:
                    yield frame(entry_ids, n_sentences, sentences)
                    entry_ids, n_sentences, sentences, n_words = [], [], [], 0
            if n_words:
                yield frame(entry_ids, n_sentences, sentences)

    return annotate_batches


def token_ids(text: Column) -> Column:
    """Token ids of a whole text: the lengths of its words."""
    words = words_of(F.coalesce(text, F.lit("")))
    return F.transform(words, lambda word: F.length(word))


def _remainder_is(wanted: int) -> Callable[[Column], Column]:
    return lambda x: x % 3 == wanted


def _class_counts(ids: Column) -> Column:
    return score_array([F.size(F.filter(ids, _remainder_is(c))) for c in range(3)])


COLUMN_SCORER = ColumnScorer(_class_counts)


def batch_scorer() -> BatchScorer:
    """The same scores from Python. The function is nested so that it travels to the
    workers by value."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            lengths = batch["ids"].map(len).to_numpy()
            row = np.repeat(np.arange(len(batch)), lengths)
            ids = np.concatenate([np.asarray(x, dtype=np.int64) for x in batch["ids"]] or [[]])
            cells = row * 3 + ids.astype(np.int64) % 3
            counts = np.bincount(cells, minlength=3 * len(batch)).astype(float).reshape(-1, 3)
            yield batch[["entry_id", "window_no"]].assign(logits=list(counts))

    return BatchScorer(score)
