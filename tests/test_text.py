from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from thoughtlog.functions import text as ft

ANCHORS = [
    ("Hoje acordei cedo", "Hoje"),
    ("AMANHÃ será melhor", "Amanhã"),
    ("cheguei às 8h em casa", "8h"),
    ("dormi 8horas", "8horas"),
    ("dormi 8hora", "8hora"),
    ("dormi 8 horas", "Não relatado"),
    ("acordei 14h30", "Não relatado"),
    ("eram 10:30:15", "10:30"),
    ("eram 110:30", "Não relatado"),
    ("foi àtarde", "Não relatado"),
    ("de Noite ou de manhã", "Noite"),
    ("ontem às 9:05", "Ontem"),
    ("anoiteceu", "Não relatado"),
    ("_tarde", "Não relatado"),
    ("", "Não relatado"),
    (None, "Não relatado"),
]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_time_anchor(spark):
    df = column(spark, [text for text, _ in ANCHORS])
    got = [r[0] for r in df.select(ft.time_anchor(F.col("x"))).collect()]
    assert got == [want for _, want in ANCHORS]


def test_capitalize_equals_python(spark):
    values = ["que ELE vai", "João Silva", "ßbe", "éa", "ÀS 8H", "", "a", "ǆx", "İSTANBUL", "ΑΣ", "1ºB"]
    got = [r[0] for r in column(spark, values).select(ft.capitalize(F.col("x"))).collect()]
    assert got == [v.capitalize() for v in values]


def test_strip_and_word_count_equal_python(spark):
    spaces = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"
    values = ["", "a", *[f"{s}a{s}b{s}{s}" for s in spaces], "​a​", " \n "]
    df = column(spark, values)
    rows = df.select(ft.strip(F.col("x")), ft.word_count(F.col("x"))).collect()
    assert [tuple(r) for r in rows] == [(v.strip(), len(v.split())) for v in values]


def test_min_words(spark):
    df = column(spark, ["um dois", "um dois três"])
    assert [r[0] for r in df.select(ft.min_words(F.col("x"), 2)).collect()] == [False, True]


def test_default_when_empty(spark):
    df = column(spark, [["a", "b"], [], None], "array<string>")
    got = df.select(ft.default_when_empty(F.col("x"), " | ", "Sem reação.")).collect()
    assert [r[0] for r in got] == ["a | b", "Sem reação.", "Sem reação."]


def test_ordered_distinct_keeps_first_places_and_is_idempotent(spark):
    df = spark.createDataFrame(
        [([(3, "b"), (1, "b"), (2, "a"), (9, "c")],)], "x array<struct<ord:int,value:string>>"
    )
    assert df.select(ft.ordered_distinct(F.col("x"))).first()[0] == ["b", "a", "c"]


def test_card_text_and_labels(spark):
    df = column(spark, ["a | b", "a|b", None])
    got = [r[0] for r in df.select(ft.card_text(F.col("x"))).collect()]
    assert got == ["a **📌** b", "a|b", None]
    names = column(spark, ["POSITIVE", "NEUTRAL", "NEGATIVE", "MIXED", None])
    got = [r[0] for r in names.select(ft.translate_label(F.col("x"))).collect()]
    assert got == ["Positivo", "Neutro", "Negativo", None, None]


@pytest.mark.parametrize("seed", [1, 2])
def test_percent_texts_equal_python(spark, seed):
    rng = random.Random(seed)
    shares = [(n, rng.randint(1, 4000)) for n in range(1500)]
    shares = [(min(n, t), t) for n, t in shares] + [(1, 8), (3, 8), (247, 2000), (1, 1000), (49, 400)]
    df = spark.createDataFrame([(n, n / t) for n, t in shares], "n bigint, share double")
    rows = df.select(
        ft.percent_text(F.col("share")), ft.matrix_cell_text(F.col("n"), F.col("share"))
    ).collect()
    assert [r[0] for r in rows] == [f"{n / t:.0%}" for n, t in shares]
    assert [r[1] for r in rows] == [f"{n}\n({n / t * 100:.1f}%)" for n, t in shares]


def test_words_and_ends_of_texts_of_any_character(spark):
    texts = [f"{chr(c)}a{chr(c)}{chr(c)}b{chr(c)}" for c in (*range(0xD800), *range(0xE000, 0x10FFFF, 97))]
    texts += ["", " ", "\t\u3000 \n", "\x1c\x1d x \x00 \x1f", "\U0001f600 \U0001f600\n\r\n", "é\x85\u2028è\u200b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    for row in df.select("t", ft.strip(F.col("t")).alias("s"), ft.word_count(F.col("t")).alias("n")).collect():
        assert (row.s, row.n) == ((row.t.strip(), len(row.t.split())) if row.t is not None else (None, None))


def test_ends_are_stripped_without_a_pattern(spark):
    """A pattern is tried at every character of a text."""
    df = spark.createDataFrame([("a",)], "t string").select(ft.strip(F.col("t")))
    assert "regexp" not in df._jdf.queryExecution().toString()
