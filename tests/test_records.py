from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from thoughtlog.operators.records import situations, triggers
from thoughtlog.plans.enrich import enrich, extract_records
from thoughtlog.schemas import PROCESSED
from thoughtlog.testing import fixture_pack as fx

ENTRIES = [
    (1, "Persona_A", "Hoje fui ao trabalho com Ana Maria. Acho que ele vai embora. Suei frio."),
    (2, "Persona_A", ""),
    (3, None, None),
    (4, "Persona_B", "Nada às 8h."),
]
TOKENS = {
    1: [
        "Hoje/hoje/ADV/advmod/2 fui/ir/VERB/root/0 ao/ao/ADP/case/4 trabalho/trabalho/NOUN/obl/2 "
        "com/com/ADP/case/6 Ana/Ana/PROPN/nmod/4@PER Maria/Maria/PROPN/flat/6@PER _././PUNCT/punct/2",
        "Acho/achar/VERB/root/0 que/que/SCONJ/mark/4 ele/ele/PRON/nsubj/4 vai/ir/VERB/ccomp/1 "
        "embora/embora/ADV/advmod/4 _././PUNCT/punct/1",
        "Suor/suor/NOUN/root/0 frio/frio/ADJ/amod/1 e/e/CCONJ/cc/4 raiva/raiva/NOUN/conj/1",
        "Ana/Ana/PROPN/root/0@PER Maria/Maria/PROPN/flat/1@PER",
    ],
    4: ["Nada/nada/NOUN/root/0 às/a/ADP/case/3 8h/8h/NOUN/nmod/1"],
}


@pytest.mark.parametrize("scorer", [fx.COLUMN_SCORER, fx.batch_scorer()], ids=["column", "batch"])
def test_enrich(make_entries, make_tokens, scorer):
    df = enrich(make_entries(ENTRIES), make_tokens(TOKENS), fx.token_ids(F.col("text")), scorer, fx.LABELS)
    assert df.schema.names == PROCESSED.names
    rows = {r.entry_id: r for r in df.collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert tuple(rows[1])[3:9] == (
        "Hoje",
        "Hoje fui ao trabalho com Ana Maria. | Ana Maria",
        "Que ele vai embora",
        "Ansiedade, Raiva",
        "Fui ao trabalho com ana maria",
        "Ana Maria",
    )
    assert rows[1].keywords == "trabalho embora suor frio raiva"
    empty = ("Não relatado", "Não descrita claramente.", "Não verbalizado.", "Falta léxico.", "Sem reação.", "")
    assert tuple(rows[2])[3:9] == empty
    assert tuple(rows[3])[3:9] == empty and rows[3].text is None
    assert rows[2].polarity == rows[3].polarity == "NEGATIVE" and rows[2].keywords == ""
    assert rows[4].time_anchor == "8h" and rows[4].keywords == ""


def test_records_with_lists(make_entries, make_tokens):
    df = extract_records(make_entries(ENTRIES), make_tokens(TOKENS), arrays=True)
    rows = {r.entry_id: r for r in df.collect()}
    assert rows[1].situations_list == ["Hoje fui ao trabalho com Ana Maria.", "Ana Maria"]
    assert rows[1].emotions_list == ["Ansiedade", "Raiva"]
    assert rows[2].triggers_list == [] and rows[2].triggers == ""


def test_single_fields(make_tokens):
    tokens = make_tokens(TOKENS)
    assert [tuple(r) for r in triggers(tokens).collect()] == [(1, "Ana Maria")]
    assert situations(tokens).count() == 1


def test_result_does_not_depend_on_partitions(make_entries, make_tokens, spark):
    def run(parts):
        df = extract_records(make_entries(ENTRIES).repartition(parts), make_tokens(TOKENS).repartition(parts))
        return sorted(map(tuple, df.collect()))

    assert run(1) == run(7)
