"""Text expressions: time anchors, capitalisation, trimming, word counts, display texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from thoughtlog.schemas import NO_TIME_ANCHOR

# What counts as whitespace when texts are stripped or split into words.
WHITESPACE = (
    r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_WHITESPACE_CHARS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# A run of anything else. Printable ASCII and the control characters are told apart first: Java walks
# through the parts of a class one by one for every character.
_WORD = rf"[!-~\x00-\x08\x0e-\x1b[\x7f-\x{{10ffff}}&&[^{WHITESPACE[1:-1]}]]]+"

# Portuguese time words, and the two clock forms.
TIME_WORDS_PT = ("hoje", "ontem", "amanhã", "manhã", "tarde", "noite", "madrugada")
CLOCK_FORMS = (r"\d{1,2}h(?:oras?)?", r"\d{1,2}:\d{2}")

DISPLAY_LABELS_PT = {"POSITIVE": "Positivo", "NEUTRAL": "Neutro", "NEGATIVE": "Negativo"}


def strip(col: Column) -> Column:
    """Remove whitespace of any kind, not only spaces, at both ends."""
    return F.btrim(col, F.lit(_WHITESPACE_CHARS))


def capitalize(col: Column) -> Column:
    """First character in title case, all others in lower case.

    The whole text is lowered before the first character is cut off, so letters whose
    lower case depends on their neighbours come out as they would inside the word.
    """
    first = F.substring(col, 1, 1)
    lowered_first = F.length(F.lower(first))
    return F.concat(F.initcap(first), F.lower(col).substr(lowered_first + 1, F.length(col) * 3))


def word_count(col: Column) -> Column:
    """Number of whitespace-separated words; null for a null text."""
    return F.regexp_count(col, F.lit(_WORD))


def min_words(col: Column, more_than: int) -> Column:
    """True where the text has more than ``more_than`` words."""
    return word_count(col) > more_than


def time_anchor(
    text: Column,
    words: Sequence[str] = TIME_WORDS_PT,
    default: str = NO_TIME_ANCHOR,
) -> Column:
    """Leftmost time word or clock form of the text, capitalised, or the default."""
    choices = "|".join([*(re.escape(word) for word in words), *CLOCK_FORMS])
    found = F.regexp_extract(text, rf"(?iuU)\b({choices})\b", 1)
    return F.when(found != "", capitalize(found)).otherwise(F.lit(default))


def default_when_empty(values: Column, separator: str, default: str) -> Column:
    """Join an array of texts, or give the default for an empty or null array."""
    return F.when(F.size(values) > 0, F.array_join(values, separator)).otherwise(F.lit(default))


def ordered_distinct(pairs: Column) -> Column:
    """Values of an array of ``(ord, value)`` structs by ``ord``, first occurrences only."""
    return F.array_distinct(F.transform(F.array_sort(pairs), lambda pair: pair["value"]))


def card_text(col: Column) -> Column:
    """Display form of a joined field: the separator becomes a pin mark."""
    return F.replace(col, F.lit(" | "), F.lit(" **📌** "))


def translate_label(label: Column, names: dict[str, str] | None = None) -> Column:
    """Display name of a polarity label, null for an unknown one."""
    names = DISPLAY_LABELS_PT if names is None else names
    pairs = [F.lit(part) for item in names.items() for part in item]
    return F.create_map(*pairs)[label]


def _tenths(value: Column) -> Column:
    """``value`` x 10 rounded half to even as if the binary value were exact.

    The product of a double and 10 may be rounded to a tie that the exact product is not.
    The rounding error of the product, found by splitting the double, settles those cases.
    """
    scaled = value * 10
    high = value.cast("float").cast("double")
    error = (high * 10 - scaled) + (value - high) * 10
    tie = (scaled - F.floor(scaled)) == 0.5
    return (
        F.when(tie & (error > 0), F.ceil(scaled).cast("double"))
        .when(tie & (error < 0), F.floor(scaled).cast("double"))
        .otherwise(F.rint(scaled))
    )


def percent_text(share: Column) -> Column:
    """Share as whole percent, e.g. ``12%``; ties go to the even number."""
    return F.format_string("%.0f%%", F.rint(share * 100))


def matrix_cell_text(n: Column, share: Column) -> Column:
    """Count over its row share with one decimal, e.g. ``7`` and ``(58.3%)`` on two lines."""
    return F.format_string("%d\n(%.1f%%)", n, _tenths(share * 100) / 10)
