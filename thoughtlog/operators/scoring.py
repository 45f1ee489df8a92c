"""Window scores, their mean per entry, and polarity labels.

A scorer is given by the user, as the expression or the Python function of a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thoughtlog.functions.binding import bind
from thoughtlog.functions.scores import BAD_SCORES, argmax, confidence, label_of, mean_vector, softmax
from thoughtlog.functions.windows import (
    INPUT_LIMIT,
    OVERLAP,
    WINDOW,
    frame_window,
    window_bounds,
    window_count,
    window_slice,
)
from thoughtlog.operators.windows import token_windows
from thoughtlog.schemas import WINDOW_SCORE


@dataclass(frozen=True)
class ColumnScorer:
    """Scores a window with a Spark expression from its ids to ``ARRAY<DOUBLE>``.

    ``input_limit`` is the longest input of the model, with the two ids of a frame.
    """

    score: Callable[[Column], Column]
    frame: tuple[int, int] | None = None
    input_limit: int = INPUT_LIMIT


@dataclass(frozen=True)
class BatchScorer:
    """Scores batches of windows with a Python function for ``mapInPandas``.

    It gets frames of ``entry_id, window_no, ids`` and gives frames of ``entry_id, window_no,
    logits``. It should load its model once, before the first batch. ``partitions`` spreads
    the windows of long entries over that many tasks before scoring. ``input_limit`` is the
    longest input of the model, with the two ids of a frame.
    """

    score: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
    frame: tuple[int, int] | None = None
    partitions: int | None = None
    input_limit: int = INPUT_LIMIT


Scorer = ColumnScorer | BatchScorer


def _model_input(ids: Column, scorer: Scorer) -> Column:
    return ids if scorer.frame is None else frame_window(ids, *scorer.frame)


def _accounted(score: Callable, fault: str) -> Callable:
    """The scorer with the books kept beside its batches.

    The number of windows that an entry has waits here for each window that the scorer was given,
    and leaves with its scores. A window that does not come back, comes back twice or was never
    given raises; as many numbers wait as the scorer holds windows back.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[tuple, int] = {}

        def keys(frame: pd.DataFrame) -> Iterator[tuple]:
            for entry, window in zip(frame["entry_id"].tolist(), frame["window_no"].tolist()):
                yield (None if entry != entry else entry, window)

        def given() -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key, n in zip(keys(batch), batch["n_windows"].tolist()):
                    if key in waiting:
                        raise ValueError(fault)
                    waiting[key] = n
                yield batch.drop(columns="n_windows")

        for scored in score(given()):
            counts = [waiting.pop(key, None) for key in keys(scored)]
            if None in counts:
                raise ValueError(fault)
            yield scored.assign(n_windows=counts)
        if waiting:
            raise ValueError(fault)

    return run


def score_windows(windows: DataFrame, scorer: Scorer) -> DataFrame:
    """``entry_id, window_no, logits`` of a window table.

    A table with ``n_windows``, the number of windows of each entry, keeps that column, and a
    Python scorer must then give back every window once.
    """
    names = ["entry_id", "window_no"]
    planned = ["n_windows"] if "n_windows" in windows.columns else []
    framed = windows.select(*names, _model_input(F.col("ids"), scorer).alias("ids"), *planned)
    if isinstance(scorer, ColumnScorer):
        return framed.select(*names, scorer.score(F.col("ids")).alias("logits"), *planned)
    if scorer.partitions is not None:
        framed = framed.repartition(scorer.partitions, *names)
    if not planned:
        return framed.mapInPandas(scorer.score, WINDOW_SCORE)
    schema = StructType([*WINDOW_SCORE, *windows.select(*planned).schema])
    return framed.mapInPandas(_accounted(scorer.score, BAD_SCORES), schema)


def mean_logits(scores: DataFrame) -> DataFrame:
    """``entry_id, logits, n_windows``: unweighted mean over the windows of an entry.

    The vectors may have any length. Averages per entry and class are combined before the
    shuffle. If the scores carry ``n_windows``, an entry with more or fewer of them raises.
    Unequal lengths and null scores always raise.
    """
    planned = F.col("n_windows") if "n_windows" in scores.columns else F.lit(None)
    each = scores.select("entry_id", planned.cast("long").alias("planned"), F.posexplode_outer("logits").alias("place", "score"))
    means = each.groupBy("entry_id", F.coalesce("place", F.lit(-1)).alias("place")).agg(
        F.avg("score").alias("mean"),
        F.count("*").alias("n"),
        F.count("score").alias("scored"),
        F.min("planned").alias("fewest"),
        F.max("planned").alias("most"),
    )
    whole = means.groupBy("entry_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "mean")))).alias("m"),
        F.min(F.least("n", "scored", "fewest")).alias("least"),
        F.max(F.greatest("n", "most")).alias("most"),
    )
    sound = (F.col("least") == F.col("most")) & (F.size("m") > 0)
    logits = F.transform("m", lambda x: x["mean"])
    return whole.select(
        "entry_id",
        F.when(sound, logits)
        .otherwise(F.raise_error(F.lit(BAD_SCORES)).cast("array<double>"))
        .alias("logits"),
        F.col("most").cast("int").alias("n_windows"),
    )


def mean_logits_column(
    ids: Column,
    scorer: ColumnScorer,
    window: int = WINDOW,
    overlap: int = OVERLAP,
) -> Column:
    """Mean window score of one entry as an expression, with no rows exchanged."""
    vectors = F.transform(
        window_bounds(F.size(ids), window, overlap, scorer.input_limit),
        lambda bounds: scorer.score(_model_input(window_slice(ids, bounds), scorer)),
    )
    return mean_vector(vectors)


def polarity_column(
    ids: Column,
    scorer: ColumnScorer,
    labels: Mapping[int, str],
    window: int = WINDOW,
    overlap: int = OVERLAP,
) -> Column:
    """Polarity of one entry as an expression of its ids; never null."""
    winner = bind(
        F.coalesce(ids, F.array().cast("array<int>")),
        lambda known: bind(
            mean_logits_column(known, scorer, window, overlap), argmax
        ),
    )
    return label_of(winner, labels)


def entry_logits(
    entries: DataFrame,
    scorer: Scorer,
    window: int = WINDOW,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``entry_id, logits, n_windows`` from ``entry_id, ids``."""
    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>"))
    if isinstance(scorer, BatchScorer):
        # one pass over the entries: each window knows how many there are of its entry
        windows = token_windows(entries, window, overlap, scorer.input_limit, counted=True)
        return mean_logits(score_windows(windows, scorer))
    logits = bind(
        ids, lambda known: mean_logits_column(known, scorer, window, overlap)
    )
    return entries.select(
        "entry_id",
        logits.alias("logits"),
        window_count(F.size(ids), window, overlap, scorer.input_limit).alias("n_windows"),
    )


def classify(
    entries: DataFrame,
    scorer: Scorer,
    labels: Mapping[int, str],
    window: int = WINDOW,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``entry_id, polarity`` from ``entry_id, ids``."""
    if isinstance(scorer, ColumnScorer):
        label = polarity_column(F.col("ids"), scorer, labels, window, overlap)
        return entries.select("entry_id", label.alias("polarity"))
    scored = entry_logits(entries, scorer, window, overlap)
    return scored.select("entry_id", label_of(argmax(F.col("logits")), labels).alias("polarity"))


def classify_detailed(
    entries: DataFrame,
    scorer: Scorer,
    labels: Mapping[int, str],
    window: int = WINDOW,
    overlap: int = OVERLAP,
) -> DataFrame:
    """As :func:`classify`, with mean scores, probabilities, windows and confidence."""
    scored = entry_logits(entries, scorer, window, overlap)
    logits = F.col("logits")
    return scored.select(
        "entry_id",
        label_of(argmax(logits), labels).alias("polarity"),
        "logits",
        softmax(logits).alias("probabilities"),
        "n_windows",
        confidence(logits).alias("confidence"),
    )
