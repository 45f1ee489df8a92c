from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from thoughtlog.functions.windows import frame_window, window_count
from thoughtlog.operators.windows import token_windows


def plain_windows(n: int, window: int, overlap: int) -> list[tuple[int, int]]:
    """Bounds by counting on: what every window table must hold."""
    bounds, start = [(0, min(window, n))], 0
    while bounds[-1][1] < n:
        start += window - overlap
        bounds.append((start, min(start + window, n)))
    return bounds


def rows_by_entry(spark, lengths, window, overlap):
    df = spark.createDataFrame(
        [(n, list(range(100, 100 + n))) for n in lengths], "entry_id bigint, ids array<int>"
    )
    found: dict[int, list] = {n: [] for n in lengths}
    for r in token_windows(df, window, overlap).orderBy("entry_id", "window_no").collect():
        assert r.ids == list(range(100 + r.start_tok, 100 + r.end_tok))
        assert r.window_no == len(found[r.entry_id])
        found[r.entry_id].append((r.start_tok, r.end_tok))
    return df, found


def test_worked_example(spark):
    _, found = rows_by_entry(spark, [12], 5, 2)
    assert found[12] == [(0, 5), (3, 8), (6, 11), (9, 12)]


@pytest.mark.parametrize(("window", "overlap"), [(5, 2), (5, 0), (5, 4), (1, 0), (7, 3), (20, 8)])
def test_windows_equal_plain_loop_and_count(spark, window, overlap):
    df, found = rows_by_entry(spark, list(range(45)), window, overlap)
    assert found == {n: plain_windows(n, window, overlap) for n in found}
    counts = df.select("entry_id", window_count(F.size("ids"), window, overlap).alias("n"))
    assert {r.entry_id: r.n for r in counts.collect()} == {n: len(b) for n, b in found.items()}


def test_default_lengths(spark):
    _, found = rows_by_entry(spark, [0, 1, 400, 401, 750, 751, 1100], 400, 50)
    assert found == {n: plain_windows(n, 400, 50) for n in found}


def test_null_ids_are_one_empty_window(spark):
    df = spark.createDataFrame([(1, None)], "entry_id bigint, ids array<int>")
    assert [(r.start_tok, r.end_tok, r.ids) for r in token_windows(df).collect()] == [(0, 0, [])]


def test_frame(spark):
    df = spark.createDataFrame([([7, 8],), ([],)], "ids array<int>")
    got = [r[0] for r in df.select(frame_window(F.col("ids"), 0, 2)).collect()]
    assert got == [[0, 7, 8, 2], [0, 2]]


@pytest.mark.parametrize(
    ("window", "overlap"), [(511, 50), (400, 400), (400, 500), (400, -1), (0, 0)]
)
def test_guards(spark, window, overlap):
    df = spark.createDataFrame([(1, [1])], "entry_id bigint, ids array<int>")
    with pytest.raises(ValueError):
        token_windows(df, window, overlap)


def test_longest_window_is_allowed(spark):
    df = spark.createDataFrame([(1, [1])], "entry_id bigint, ids array<int>")
    assert token_windows(df, 510, 50).count() == 1
