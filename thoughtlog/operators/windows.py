"""Token windows as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thoughtlog.functions.windows import INPUT_LIMIT, OVERLAP, WINDOW, window_bounds, window_count, window_slice


def token_windows(
    entries: DataFrame,
    window: int = WINDOW,
    overlap: int = OVERLAP,
    input_limit: int = INPUT_LIMIT,
    counted: bool = False,
) -> DataFrame:
    """``entry_id, window_no, start_tok, end_tok, ids`` from ``entry_id, ids``.

    A narrow step: every entry is cut where it lies. Null ids are an empty text. A window and the
    ids of its frame must fit into ``input_limit``. ``counted`` adds ``n_windows``, the number of
    windows of the entry.
    """
    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>"))
    n_windows = window_count(F.size("ids"), window, overlap, input_limit).alias("n_windows")
    rows = entries.select("entry_id", ids.alias("ids")).select(
        "entry_id", "ids", n_windows, F.posexplode(window_bounds(F.size("ids"), window, overlap, input_limit))
    )
    return rows.select(
        "entry_id",
        F.col("pos").alias("window_no"),
        F.col("col.start_tok").alias("start_tok"),
        F.col("col.end_tok").alias("end_tok"),
        window_slice(F.col("ids"), F.col("col")).alias("ids"),
        *(["n_windows"] if counted else []),
    )
