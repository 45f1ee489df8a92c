"""Expressions for overlapping windows over an array of token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default window length and overlap, model input limit, added ids per window.
WINDOW = 400
OVERLAP = 50
INPUT_LIMIT = 512
FRAME_IDS = 2


def check_window(window: int, overlap: int, input_limit: int = INPUT_LIMIT) -> None:
    """Refuse lengths the model cannot take and overlaps that would not advance or skip."""
    if window < 1 or window + FRAME_IDS > input_limit:
        raise ValueError(
            f"window={window} must be at least 1 and, with {FRAME_IDS} frame ids, "
            f"at most {input_limit}"
        )
    if not 0 <= overlap < window:
        raise ValueError(f"overlap={overlap} must be from 0 to below window={window}")


def window_count(
    n_tokens: Column, window: int = WINDOW, overlap: int = OVERLAP, input_limit: int = INPUT_LIMIT
) -> Column:
    """How many windows a text of ``n_tokens`` ids gives; a short or empty text gives one."""
    check_window(window, overlap, input_limit)
    further = F.ceil((n_tokens - window) / F.lit(window - overlap))
    return (F.greatest(further, F.lit(0)) + 1).cast("int")


def window_bounds(
    n_tokens: Column, window: int = WINDOW, overlap: int = OVERLAP, input_limit: int = INPUT_LIMIT
) -> Column:
    """Array of half-open ``(start_tok, end_tok)`` structs that cover the ids."""
    last = window_count(n_tokens, window, overlap, input_limit) - 1
    stride = window - overlap
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(
            (k * stride).cast("int").alias("start_tok"),
            F.least(k * stride + window, n_tokens).cast("int").alias("end_tok"),
        ),
    )


def window_slice(ids: Column, bounds: Column) -> Column:
    """The ids of one window."""
    return F.slice(ids, bounds["start_tok"] + 1, bounds["end_tok"] - bounds["start_tok"])


def frame_window(ids: Column, first: int, last: int) -> Column:
    """Window ids with the start and end ids a model expects."""
    return F.concat(F.array(F.lit(first)), ids, F.array(F.lit(last)))
