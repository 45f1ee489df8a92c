"""Findings of sentences: the same however the tokens are cut into batches or dealt."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from thoughtlog.operators.clauses import clauses
from thoughtlog.operators.findings import findings, sentence_findings
from thoughtlog.operators.phrases import match_phrases, phrase_places
from thoughtlog.operators.records import situation_findings, trigger_findings
from thoughtlog.schemas import TOKEN
from thoughtlog.testing import fixture_pack as fx

WORDS = ["the", "and", "that", "for", "with", "from", "this", "anea", "Paul", "thanedble", "sing", "x"]


@pytest.fixture(scope="module")
def tokens(spark):
    rng = random.Random(5)
    texts = [(i, ". ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))) for _ in range(6))) for i in range(60)]
    made = fx.annotate(spark.createDataFrame([*texts, (None, "the and. That from this")], "entry_id bigint, text string"))
    rows = [tuple(r) for r in made.collect()]
    return spark.createDataFrame(rows, TOKEN)


def rows_of(df, *kinds):
    return sorted(tuple(r) for r in df.where(F.col("kind").isin(*kinds)).select("entry_id", "kind", "ord", "value").fillna(-1, ["entry_id"]).collect())


def test_findings_are_those_of_the_single_operators(tokens):
    found = findings(tokens.repartition(5), fx.LEXICON).cache()
    assert rows_of(found, "thought", "reaction") == rows_of(clauses(tokens, fx.LEXICON), "thought", "reaction") != []
    assert rows_of(found, "situation") == rows_of(situation_findings(tokens, fx.LEXICON), "situation") != []
    assert rows_of(found, "trigger") == rows_of(trigger_findings(tokens), "trigger") != []
    whole = match_phrases(tokens, fx.LEXICON)
    inside = rows_of(found, "emotion")
    assert 0 < len(inside) <= whole.count() and rows_of(found, "part")


def test_findings_do_not_depend_on_batches(tokens):
    """A sentence may begin in one batch and end many batches later."""
    table = tokens.sort("entry_id", "sent_no", "tok_no").toArrow()
    n = table.num_rows
    place, last = [], None
    for key in zip(table.column("entry_id").to_pylist(), table.column("sent_no").to_pylist()):
        place.append(place[-1] + 1 if key == last else 1)
        last = key
    lemma = table.column("lemma").to_pylist()
    number = {x: i for i, x in enumerate(sorted({p[4] for p in phrase_places(fx.LEXICON)}))}
    rng = random.Random(1)
    fields = {
        "entry_id": table.column("entry_id"), "sent_no": table.column("sent_no"), "tok_no": table.column("tok_no"), "head": table.column("head"),
        "piece": table.column("text"), "verb_text": table.column("text"), "tags": pa.array([rng.randrange(64) for _ in range(n)], pa.int32()),
        "ent_id": table.column("ent_id"), "keyword": pa.array([x if len(x) > 3 else None for x in lemma]),
        "lemma_no": pa.array([number.get(x) for x in lemma], pa.int32()), "place": pa.array(place, pa.int32()),
    }
    made = pa.table(fields).combine_chunks()

    def run(size):
        out = pa.Table.from_batches(list(sentence_findings(phrase_places(fx.LEXICON))(iter(made.to_batches(max_chunksize=size)))))
        words = {}
        for r in out.to_pylist():
            if r["kind"] == "keyword":
                words.setdefault(r["entry_id"], []).extend((w["ord"], w["value"]) for w in r["words"])
        return sorted(map(repr, (tuple(r.values()) for r in out.to_pylist() if r["kind"] != "keyword"))), words

    assert run(n) == run(1) == run(7)


def test_no_token_table_is_stored_to_be_read_once(spark, tmp_path):
    rows = [(i, f"The anea is than. That with Paul {i}, the and. From this.", "src1") for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("enriched_corpus", "enriched_corpus_python", "records"):
        text = contract.queries()[name](spark, str(tmp_path))._jdf.queryExecution().toString()
        assert "tokens_" not in text and "collect_list(word" not in text, name
