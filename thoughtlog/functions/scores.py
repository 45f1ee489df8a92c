"""Expressions over class-score vectors (``ARRAY<DOUBLE>``) and class labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from thoughtlog.functions.binding import bind
from thoughtlog.schemas import DEFAULT_LABEL

BAD_SCORES = "score vectors of an entry must have one length and no missing score or window"

# Numeric value of each polarity label.
POLARITY_VALUES = {"POSITIVE": 1, "NEUTRAL": 0, "NEGATIVE": -1}


def argmax(logits: Column) -> Column:
    """Index (from 0) of the largest score; the first one wins a tie."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def softmax(logits: Column) -> Column:
    """Probabilities of the scores, shifted by the maximum before exponentiation."""
    top = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(exps, lambda x: x / total)


def confidence(logits: Column) -> Column:
    """Probability of the winning class.

    The winner is the maximum itself, so its shifted exponential is 1.
    """
    top = F.array_max(logits)
    return 1.0 / F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))


def label_of(
    index: Column, labels: Mapping[int, str], default: str = DEFAULT_LABEL
) -> Column:
    """Upper-case label of a class index; the default where the index has none."""
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.upper(F.coalesce(F.create_map(*pairs)[index], F.lit(default)))


def polarity_value(label: Column) -> Column:
    """1, 0 or -1 for a polarity label, null for anything else."""
    value = F.lit(None).cast("int")
    for name, number in POLARITY_VALUES.items():
        value = F.when(label == name, F.lit(number)).otherwise(value)
    return value


def mean_vector(vectors: Column) -> Column:
    """Element-wise unweighted mean of an array of score vectors, as long as they are.

    Raises if there is none, if their lengths differ, or if a score is missing.
    """

    def mean(known: Column) -> Column:
        first = known[0]
        total = F.aggregate(
            F.slice(known, F.lit(2), F.size(known)),
            first,
            lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b),
        )
        sound = F.forall(
            known,
            lambda v: (F.size(v) == F.size(first)) & ~F.exists(v, lambda x: x.isNull()),
        )
        return F.when(
            F.coalesce(sound, F.lit(False)) & (F.size(known) > 0) & (F.size(first) > 0),
            F.transform(total, lambda x: x / F.size(known)),
        ).otherwise(F.raise_error(F.lit(BAD_SCORES)).cast("array<double>"))

    return bind(vectors, mean)


def score_array(parts: Sequence[Column]) -> Column:
    """Score vector from one expression per class."""
    return F.array(*[part.cast("double") for part in parts])
