from __future__ import annotations

import pytest

from thoughtlog.operators import timeline as tl
from thoughtlog.operators.numbering import day_number
from thoughtlog.operators.prompts import persona_table, prompt_grid
from thoughtlog.plans.persona_views import persona_view_rows, persona_views
from thoughtlog.schemas import PROCESSED

LABELS = ["POSITIVE", "NEUTRAL", "NEGATIVE", None]


@pytest.fixture(scope="module")
def processed(spark):
    rows, entry_id = [], 0
    for persona, n in (("a", 1), ("b", 7), ("c", 8), ("d", 15)):
        for i in range(n):
            entry_id += 1
            emotions = "Falta léxico." if persona == "b" else ("Ansiedade, Raiva" if i % 2 else "Raiva")
            rows.append(
                (entry_id, persona, f"t{entry_id}", "Hoje", "s1 | s2", "p", emotions, "r", "", LABELS[i % 4], f"k{i % 2} k")
            )
    return spark.createDataFrame(rows, PROCESSED)


def test_calendar_borders(processed):
    calendar = tl.with_calendar(day_number(processed))
    rows = {(r.persona, r.day_no): (r.week_no, r.day_of_week, r.polarity_value) for r in calendar.collect()}
    assert rows["b", 7][:2] == (1, 7)
    assert rows["c", 8][:2] == (2, 1)
    assert rows["d", 15][:2] == (3, 1)
    assert [rows["d", d][2] for d in (1, 2, 3, 4)] == [1, 0, -1, None]


def test_persona_slice(processed):
    got = tl.persona_slice(processed, "c").orderBy("day_no").collect()
    assert [r.day_no for r in got] == list(range(1, 9)) and {r.persona for r in got} == {"c"}


def test_heatmap(processed):
    rows = {(r.persona, r.week_no): r for r in tl.mood_heatmap(tl.with_calendar(day_number(processed))).collect()}
    assert set(rows) == {("a", 1), ("b", 1), ("c", 1), ("c", 2), ("d", 1), ("d", 2), ("d", 3)}
    first = rows["d", 1]
    assert [first[f"d{d}"] for d in range(1, 8)] == [1, 0, -1, None, 1, 0, -1]
    assert rows["a", 1].d2 is None


def test_summary_counts_null_labels_in_total(processed):
    rows = {r.persona: r for r in tl.polarity_summary(processed).collect()}
    assert (rows["d"].total, rows["d"].n_positive, rows["d"].n_neutral, rows["d"].n_negative) == (15, 4, 4, 4)
    assert rows["c"].text_positive == f"{2 / 8:.0%}"
    assert rows["a"].share_positive == 1.0


def test_emotions_and_personas(processed):
    got = [tuple(r) for r in tl.emotion_frequency(processed).collect()]
    assert got == [
        ("a", "Raiva", 1),
        ("c", "Raiva", 8),
        ("c", "Ansiedade", 4),
        ("d", "Raiva", 15),
        ("d", "Ansiedade", 7),
    ]
    assert [r.persona for r in tl.persona_list(processed).collect()] == ["a", "b", "c", "d"]


def test_record_for_day(processed):
    rows = {r.persona: r for r in tl.record_for_day(processed, 8).collect()}
    assert set(rows) == {"c", "d"} and rows["c"].situations == "s1 **📌** s2"
    only = tl.record_for_day(processed, 1, "b").collect()
    assert [(r.persona, r.text) for r in only] == [("b", "t2")]


def test_views(processed):
    views = persona_views(processed)
    series = [(r.persona, r.day_no) for r in views["series"].collect()]
    assert series == sorted(series) and len(series) == 31
    rows = persona_view_rows(processed, 1).collect()
    terms = {(r.persona, r["item"]): r["value"] for r in rows if r["view"] == "terms"}
    assert terms == {("a", "k"): 1, ("b", "k"): 7, ("c", "k"): 8, ("d", "k"): 15}


def test_prompt_grid(spark):
    grid = prompt_grid(persona_table(spark)).orderBy("grid_no").collect()
    assert len(grid) == 300 and [r.grid_no for r in grid] == list(range(300))
    assert (grid[60].persona, grid[60].day) == ("Persona_B", 1)
    assert grid[60].request.startswith("Escreva o dia 1/60 do diário de: Sheldon, 35 anos, São Paulo.")
