"""Token tables of the queries: where their rows lie, and how annotators give them."""

from __future__ import annotations

import re

import pandas as pd

import __spark_entry__ as contract
from thoughtlog.testing import fixture_pack as fx


def test_tokens_are_not_shuffled_to_be_grouped(spark, tmp_path):
    """Texts are dealt by entry before their tokens are made, so only texts are shuffled."""
    rows = [(i, f"The anea is than. That with Paul {i}, the and. From this.", "src1") for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    found = contract.queries()["sentence_texts"](spark, str(tmp_path))
    text = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert text.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in text
    assert found.count() == 120
    for name in ("thoughts", "reactions"):
        found = contract.queries()[name](spark, str(tmp_path))
        text = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert not re.search(r"Exchange hashpartitioning\(entry_id#\d+L?, sent_no", text), text


def test_annotator_gives_many_entries_in_a_frame():
    batch = pd.DataFrame({"entry_id": [1, 2, 3, 4], "text": ["One Two. three", "", "...", "É x"]})
    frames = list(fx.batch_annotator()(iter([batch])))
    assert len(frames) == 1
    rows = frames[0].astype(object).where(frames[0].notna(), None).values.tolist()
    assert [r[:5] for r in rows] == [[1, 1, 1, 0, "One"], [1, 1, 2, 1, "Two"], [1, 2, 3, 0, "three"], [4, 1, 1, 0, "É"], [4, 1, 2, 1, "x"]]
    assert [r[9:11] for r in rows] == [[None, None], [2, "PER"], [None, None], [None, None], [None, None]]


def test_stored_tokens_are_not_shuffled_for_subtrees(spark, tmp_path):
    """Verbs and seeds are looked up in their entry, and the tokens lie in buckets of entries."""
    rows = [(i, f"The anea is than. That with Paul {i}, the and so on. From this one to that other.", "src1") for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    for name in ("subtree_text", "subtree_members"):
        found = contract.queries()[name](spark, str(tmp_path))
        text = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert "Exchange hashpartitioning" not in text, text
        assert found.count() >= 40
