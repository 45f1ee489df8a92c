from __future__ import annotations

import pytest

from thoughtlog.operators import evaluation as ev
from thoughtlog.plans.evaluate import evaluate, evaluation_summary
from thoughtlog.sources.gold import gold_table

# expected, predicted, n
COUNTS = [
    ("NEGATIVE", "NEGATIVE", 6),
    ("NEGATIVE", "NEUTRAL", 2),
    ("POSITIVE", "POSITIVE", 3),
    ("POSITIVE", "NEGATIVE", 1),
    ("POSITIVE", "NEUTRAL", 1),
]


def counts(spark, rows=COUNTS):
    return spark.createDataFrame(rows, "expected string, predicted string, n bigint")


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_matrix_is_filled_with_zeros(spark):
    normalized = ev.confusion_normalized(ev.confusion_matrix(counts(spark)))
    rows = by(normalized, "expected", "predicted")
    assert len(rows) == 9
    assert rows["NEGATIVE", "POSITIVE"].n == 0
    assert rows["NEGATIVE", "NEGATIVE"].share == 0.75
    assert rows["NEUTRAL", "NEUTRAL"].share == 0.0
    assert sum(r.n for r in rows.values()) == sum(n for *_, n in COUNTS)
    cells = by(ev.matrix_cells(normalized), "expected", "predicted")
    assert cells["POSITIVE", "POSITIVE"].cell == "3\n(60.0%)"
    assert cells["NEUTRAL", "POSITIVE"].expected_name == "Neutro"


def test_matrix_of_given_classes(spark):
    rows = by(ev.confusion_matrix(counts(spark), ["POSITIVE", "MIXED"]), "expected", "predicted")
    assert {k: r.n for k, r in rows.items()} == {
        ("POSITIVE", "POSITIVE"): 3,
        ("POSITIVE", "MIXED"): 0,
        ("MIXED", "POSITIVE"): 0,
        ("MIXED", "MIXED"): 0,
    }


def test_report_by_hand(spark):
    report = ev.per_class_report(counts(spark))
    rows = by(report, "label")
    assert tuple(rows[("NEGATIVE",)])[1:] == pytest.approx((6 / 7, 6 / 8, 12 / 15, 8))
    assert tuple(rows[("NEUTRAL",)])[1:] == pytest.approx((0, 0, 0, 0))
    assert tuple(rows[("POSITIVE",)])[1:] == pytest.approx((1, 3 / 5, 6 / 8, 5))
    assert ev.accuracy(counts(spark)).first()[0] == pytest.approx(9 / 13)
    macro = ev.macro_metrics(report).first()
    assert tuple(macro) == pytest.approx(((6 / 7 + 1) / 3, (0.75 + 0.6) / 3, (0.8 + 0.75) / 3))
    weighted = ev.weighted_metrics(report).first()
    assert weighted.recall == pytest.approx(9 / 13)
    assert weighted.precision == pytest.approx((8 * 6 / 7 + 5) / 13)


def test_no_pairs(spark):
    empty = counts(spark, [])
    assert ev.accuracy(empty).first()[0] == 0
    assert ev.per_class_report(empty).count() == 0
    assert ev.confusion_matrix(empty).count() == 0
    assert [r.value for r in ev.class_metric_bars(ev.per_class_report(empty)).collect()] == [0.0] * 9


def test_bars_links_and_labels(spark):
    rows = [*COUNTS, ("MIXED", "POSITIVE", 4)]
    data = counts(spark, rows)
    bars = by(ev.class_metric_bars(ev.per_class_report(data)), "label", "metric")
    assert len(bars) == 9 and bars["NEUTRAL", "precision"].value == 0
    links = {(r.source, r.target): (r.value, r.hit) for r in ev.flow_links(data).collect()}
    assert links == {(0, 3): (6, True), (0, 4): (2, False), (2, 5): (3, True), (2, 3): (1, False), (2, 4): (1, False)}
    assert [r.label for r in ev.label_union(data).collect()] == ["MIXED", "NEGATIVE", "NEUTRAL", "POSITIVE"]
    present = ev.present_classes(counts(spark, COUNTS[:1])).collect()
    assert [(r.place, r.label) for r in present] == [(0, "NEGATIVE")]


def processed(spark, column="polarity"):
    rows = [
        (1, "Persona_A", "POSITIVE"),
        (2, "Persona_A", None),
        (3, "Persona_B", "NEUTRAL"),
        (4, "Persona_X", "NEGATIVE"),
        (5, "Persona_X", "NEGATIVE"),
        (6, None, "NEGATIVE"),
        (7, "Persona_B", "NEGATIVE"),
    ]
    return spark.createDataFrame(rows, f"entry_id bigint, persona string, {column} string")


@pytest.mark.parametrize("column", ["polarity", "polarity_old"])
def test_gold_and_pairs(spark, column):
    df, gold = processed(spark, column), gold_table(spark)
    pairs = ev.valid_pairs(ev.attach_gold(df, gold))
    want = {("POSITIVE", "POSITIVE"): 1, ("NEGATIVE", "NEUTRAL"): 1, ("NEGATIVE", "NEGATIVE"): 1}
    for counted in (ev.pair_counts(pairs), ev.persona_pair_counts(df, gold)):
        assert {(r.expected, r.predicted): r.n for r in counted.collect()} == want
    unknown = {r.persona: r.n_entries for r in ev.unknown_personas(df, gold).collect()}
    assert unknown == {"Persona_X": 2, None: 1}


def test_both_label_columns_prefers_the_new(spark):
    df = processed(spark).withColumnRenamed("entry_id", "polarity_old")
    assert ev.prediction_column(df) == "polarity"


def test_evaluate_by_entry_and_persona(spark):
    by_persona = evaluate(processed(spark), gold_table(spark))
    assert by_persona["accuracy"].first()[0] == pytest.approx(2 / 3)
    matrix = by_persona["canonical_matrix"].collect()
    assert sorted({(r.row_no, r.expected) for r in matrix}) == [(0, "NEGATIVE"), (1, "NEUTRAL"), (2, "POSITIVE")]
    gold = spark.createDataFrame([(1, "POSITIVE"), (4, "POSITIVE")], "entry_id bigint, expected string")
    rows = evaluation_summary(processed(spark), gold, "entry_id").collect()
    assert {(r.scope, r.label, r.metric): r.value for r in rows}["overall", "all", "accuracy"] == 0.5
