from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thoughtlog.schemas import PROCESSED
from thoughtlog.sources import corpus, scratch
from thoughtlog.sources.sizes import literal_table

TEXTS = [
    (1, "Persona_A", 'linha um\nlinha "dois", com vírgula'),
    (2, "Persona_A", "  espaços  "),
    (3, "Persona_B", "NA"),
    (4, "Persona_B", r"barra \ e \" fim\\"),
    (5, None, None),
]


def test_corpus_round_trip(spark, make_entries):
    for fmt in ("csv", "parquet"):
        path = scratch.fresh_path(spark, "test-corpus")
        corpus.write_corpus(make_entries(TEXTS), path, fmt)
        got = sorted(map(tuple, corpus.read_corpus(spark, path, fmt).collect()))
        assert got == TEXTS


def test_reads_exchanged_csv_with_bom(spark, tmp_path):
    path = tmp_path / "corpus.csv"
    path.write_text('id_registro,persona,texto_diario\r\n1,Persona_A,"um\ndois ""x"""\r\n2,Persona_B,\r\n', "utf-8-sig")
    rows = corpus.read_corpus(spark, str(path), "csv").collect()
    assert [tuple(r) for r in rows] == [(1, "Persona_A", 'um\ndois "x"'), (2, "Persona_B", None)]


def test_processed_round_trip_and_empty_fields(spark):
    row = (1, "p", "t", "Hoje", "s | s2", "p", "e", "r", "", "POSITIVE", "")
    df = spark.createDataFrame([row], PROCESSED)
    path = scratch.fresh_path(spark, "test-processed")
    corpus.write_processed(df, path)
    assert tuple(corpus.read_processed(spark, path).first()) == row
    corpus.write_processed(df, path + "-csv", "csv")
    back = tuple(corpus.read_processed(spark, path + "-csv", "csv").first())
    assert back == tuple(None if v == "" else v for v in row)
    header = spark.read.text(path + "-csv").first()[0]
    assert header.startswith("id_registro,persona,texto_diario,Data/Hora,")
    with pytest.raises(Exception):
        corpus.write_processed(df, path)


def test_processed_columns_are_found_by_header(spark, tmp_path):
    path = tmp_path / "old.csv"
    path.write_text(
        "persona,id_registro,texto_diario,Data/Hora,Situação,Pensamentos,Emoção Física,Reação,Gatilhos,"
        "Polaridade (BERT),Palavras_Nuvem\nA,1,t,Hoje,s,p,e,r,g,NEUTRAL,k\n",
        "utf-8",
    )
    df = corpus.read_processed(spark, str(path), "csv")
    assert "polarity" not in df.columns
    row = df.first()
    assert (row.entry_id, row.persona, row.polarity_old, row.keywords) == (1, "A", "NEUTRAL", "k")


def test_shared_folder_is_the_sessions(spark):
    folder = scratch.shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir").rstrip("/") == folder
    stored = scratch.materialize(spark.range(5), "test")
    assert stored.count() == 5 and folder in stored.inputFiles()[0]


def test_literal_tables(spark):
    table = literal_table(spark, [(1, "a"), (2, None)], n=pa.int32(), s=pa.string())
    assert sorted(map(str, table.collect())) == ["Row(n=1, s='a')", "Row(n=2, s=None)"]
    assert literal_table(spark, [], n=pa.int32()).count() == 0


def test_stored_tables_are_removed_together(spark):
    with scratch.scratch(spark) as tables:
        stored = tables.store(spark.range(5), "test")
        path = stored.inputFiles()[0].removeprefix("file://").removeprefix("file:")
        assert stored.count() == 5 and Path(path).exists()
    assert not Path(path).exists()


STOCK_SESSION = """
from pyspark.sql import SparkSession
from thoughtlog.sources import scratch
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
try:
    scratch.shared_folder(spark)
except ValueError as error:
    assert "spark.checkpoint.dir" in str(error)
else:
    raise AssertionError("no folder, but no error")
assert scratch.materialize(spark.range(3), "t", "{0}/given").count() == 3
spark.sparkContext.setCheckpointDir("{0}/checkpoints")
assert scratch.materialize(spark.range(4), "t").count() == 4
"""


def test_a_stock_session_needs_a_folder(tmp_path):
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    done = subprocess.run([sys.executable, "-c", STOCK_SESSION.format(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_csv_starts_with_a_mark(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A", "é, \n\"x\"")], "entry_id bigint, persona string, text string")
    corpus.write_corpus(rows, str(tmp_path / "c"), "csv")
    file = next((tmp_path / "c").glob("part-*.csv"))
    assert file.read_bytes().startswith(b"\xef\xbb\xbfid_registro,persona,texto_diario\n")
    assert [tuple(r) for r in corpus.read_corpus(spark, str(tmp_path / "c"), "csv").collect()] == [(1, "A", "é, \n\"x\"")]


def test_bucketed_entries_and_tokens_meet_without_a_shuffle(spark, tmp_path):
    entries = spark.range(50).selectExpr("id AS entry_id", "concat('t', id) AS text")
    parts = spark.range(200).selectExpr("id % 50 AS entry_id", "id AS tok_no")
    corpus.write_bucketed(entries, "bucketed_entries", 4, "overwrite")
    corpus.write_bucketed(parts, "bucketed_tokens", 4, "overwrite")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        counts = corpus.read_bucketed(spark, "bucketed_tokens").groupBy("entry_id").count()
        joined = corpus.read_bucketed(spark, "bucketed_entries").join(counts, "entry_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_entries")
        spark.sql("DROP TABLE bucketed_tokens")


def test_tokens_are_written_and_read(spark, make_tokens, tmp_path):
    tokens = make_tokens({1: ["Eu/eu/PRON/nsubj/2 vou/ir/VERB/root/0"]})
    corpus.write_tokens(tokens, str(tmp_path / "t"))
    got = corpus.read_tokens(spark, str(tmp_path / "t")).sort("tok_no").collect()
    assert got == tokens.sort("tok_no").collect()
