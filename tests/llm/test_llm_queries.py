"""The registered queries beside their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from thoughtlog.llm.oracles import ORACLES
from thoughtlog.llm.queries import QUERIES
from workload.compare import _rows, database

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    con = database(SF_DIR)
    con.execute(ORACLES[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, con.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op13_spelling_variants"}))  # its rows are words
def test_query_has_a_row_for_each_document(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    ids = {r.doc_id for r in df.select("doc_id").collect()}
    assert ids == {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()}


def test_languages_of_held_out_documents(spark):
    df = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = df.where("held_out").join(lang, "doc_id").selectExpr("avg(CAST(lang = lang_pred AS INT)) AS a").first().a
    assert right > 0.97


def test_stages_keep_columns_and_odd_rows(spark, docs, tmp_path):
    names = ("n_lines", "n_dropped", "n_words", "n_hit", "items", "lang_pred", "others", "a b")
    kept = docs.withColumn("more", docs.score + 1)
    kept = kept.withColumns({n: F.concat(F.lit(n), docs.doc_id.cast("string")) for n in names})
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, SF_DIR)
        if number < 4:
            assert out.columns == kept.columns and out.schema.simpleString() == kept.schema.simpleString()
            assert out.where(" OR ".join(f"`{n}` <> concat('{n}', doc_id)" for n in names) + " OR score <> 5").count() == 0
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
    assert kept.count() > 0


def test_stages_take_empty_tables(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0


def test_short_texts_keep_their_likeness(spark, tmp_path):
    import random

    r = random.Random(4)
    texts = ["".join(r.choice("abcdefghijklmnop ") for _ in range(60 + 2 * i)) for i in range(30)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [x.near_edited for x in QUERIES["op3_winnowing"](spark, str(tmp_path)).collect()]
    assert len(found) == len(texts) and min(found) > 0.1, sorted(found)


def test_fingerprints_are_whole_in_fewer_digits(spark, docs, tmp_path):
    from base64 import b64decode

    from thoughtlog.llm import winnowing

    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    want = {r.doc_id: r for r in winnowing.compare_edited(docs, winnowing.DENSE_GRAM, winnowing.DENSE_WINDOW).collect()}
    got = QUERIES["op3_winnowing"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        for name in ("fingerprint", "edited_fingerprint"):
            assert b64decode(r[name], validate=True).hex() == want[r.doc_id][name]
            assert len(r[name]) <= 2 / 3 * len(want[r.doc_id][name]) + 3
        assert [r[c] for c in ("positions", "near_edited", "near_next")] == [want[r.doc_id][c] for c in ("positions", "near_edited", "near_next")]
