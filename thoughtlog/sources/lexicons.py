"""Word lists as Python packs and as dimension tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from thoughtlog.functions.text import TIME_WORDS_PT
from thoughtlog.sources.sizes import literal_table


@dataclass(frozen=True)
class Lexicon:
    """All word lists the record and keyword operators read.

    ``emotion_phrases`` maps a category to phrases; a phrase is a sequence of lemmas, given
    as one text with spaces or, where the annotator lemmatises otherwise, as a list.
    """

    time_words: Sequence[str]
    context_nouns: frozenset[str]
    cognitive_verbs: frozenset[str]
    action_verbs: frozenset[str]
    stopwords: frozenset[str]
    emotion_phrases: Mapping[str, Sequence[str | Sequence[str]]]
    thought_deps: frozenset[str] = frozenset({"ccomp"})
    reaction_deps: frozenset[str] = frozenset({"xcomp", "dobj", "obl"})

    def phrases(self) -> list[tuple[int, str, list[str]]]:
        """``(phrase_no, category, lemmas)`` of every phrase."""
        flat = [
            (category, phrase.split() if isinstance(phrase, str) else list(phrase))
            for category, phrases in self.emotion_phrases.items()
            for phrase in phrases
        ]
        return [(no, category, lemmas) for no, (category, lemmas) in enumerate(flat, 1)]


# The Portuguese word lists.
PORTUGUESE = Lexicon(
    time_words=TIME_WORDS_PT,
    context_nouns=frozenset(
        (
            "trabalho", "casa", "rua", "mercado", "reunião", "chefe", "escola", "faculdade",
            "ônibus", "carro", "projeto", "parque", "amiga", "amigo", "esposa",
        )
    ),
    cognitive_verbs=frozenset(
        (
            "pensar", "achar", "imaginar", "acreditar", "concluir", "ter", "saber", "sentir",
        )
    ),
    action_verbs=frozenset(
        (
            "fazer", "ir", "parar", "cancelar", "sair", "trancar", "bater", "evitar", "chorar",
            "voltar",
        )
    ),
    stopwords=frozenset(
        (
            "hoje", "dia", "mesmo", "hora", "coisa", "vez", "pouco", "nada", "tudo", "ano",
        )
    ),
    emotion_phrases={
        "Ansiedade": (
            "nó no estômago",
            "coração acelerar",
            "suor frio",
            "mão suar",
            "ansioso",
            "ansiedade",
            "pânico",
        ),
        "Angústia": (
            "aperto no peito",
            "peso nas costas",
            "vontade de sumir",
            "tristeza",
            "buraco no peito",
            "triste",
        ),
        "Raiva": ("sangue ferver", "ficar cego", "corpo quente", "ódio", "irritado", "raiva"),
        "Exaustão": (
            "bateria acabar",
            "corpo pesado",
            "mente nublado",
            "exausto",
            "apagão mental",
            "cansado",
        ),
    },
)


def lexicon_tables(spark: SparkSession, lexicon: Lexicon = PORTUGUESE) -> dict[str, DataFrame]:
    """Dimension tables of a pack: one ``words`` table and one ``phrases`` table."""
    lists = {
        "context_nouns": lexicon.context_nouns,
        "cognitive_verbs": lexicon.cognitive_verbs,
        "action_verbs": lexicon.action_verbs,
        "stopwords": lexicon.stopwords,
    }
    words = [(name, word) for name, members in lists.items() for word in sorted(members)]
    return {
        "words": literal_table(spark, words, list=pa.string(), word=pa.string()),
        "phrases": literal_table(
            spark,
            lexicon.phrases(),
            phrase_no=pa.int32(),
            category=pa.string(),
            lemmas=pa.list_(pa.string()),
        ),
    }
