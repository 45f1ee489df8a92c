"""Where the texts of op6 lie."""

from __future__ import annotations

from thoughtlog.llm import backoff


def test_texts_are_not_shuffled_to_be_scored(spark):
    rows = [(i, f"one two three four {i % 7} one two") for i in range(300)] + [(None, None), (None, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = backoff.score(docs)
    text = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and "Bucketed: true" in text, text
    got = found.collect()
    assert len(got) == 302 and sorted(r.n_words for r in got)[:2] == [0, 3]
