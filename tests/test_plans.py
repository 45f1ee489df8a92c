"""Physical plans: what is read, what is shuffled, and what is sent to every executor."""

from __future__ import annotations

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from thoughtlog.operators import scoring as osc
from thoughtlog.operators import timeline
from thoughtlog.operators.clauses import clause_seeds, clauses, subtree_text
from thoughtlog.operators.evaluation import attach_gold, persona_pair_counts
from thoughtlog.operators.keywords import keyword_tokens, term_frequency, top_terms
from thoughtlog.operators.numbering import assign_ids, running_number
from thoughtlog.operators.phrases import match_phrases, phrase_places, vote_in_place
from thoughtlog.operators.tokens import tokenize
from thoughtlog.plans.enrich import enrich, extract_records
from thoughtlog.plans.evaluate import evaluate, evaluation_summary
from thoughtlog.plans.persona_views import persona_view_rows, persona_views
from thoughtlog.schemas import PROCESSED
from thoughtlog.sources import corpus, scratch
from thoughtlog.sources.gold import gold_table
from thoughtlog.sources.lexicons import PORTUGUESE
from thoughtlog.testing import fixture_pack as fx
from workload.queries import documents

SF_DIR = "/root/testdata/sf0.001"
JOINING = (
    "attach_entry_gold",
    "attach_results_by_entry",
    "assign_ids",
    "confusion_normalized",
    "class_metric_bars",
    "emotion_frequency",
    "mood_heatmap",
    "present_classes",
    "prompt_grid",
    "unknown_personas",
)


def plan(df) -> str:
    """Simple form of the plan, without the trimming of long lists."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )


@pytest.fixture(scope="module")
def tokens(spark):
    path = scratch.fresh_path(spark, "plan-tokens")
    fx.annotate(documents(spark, SF_DIR)).write.parquet(path)
    return corpus.read_tokens(spark, path)


@pytest.fixture(scope="module")
def stored(spark):
    path = scratch.fresh_path(spark, "plan-processed")
    spark.createDataFrame([], PROCESSED).write.parquet(path)
    return corpus.read_processed(spark, path)


def test_no_query_multiplies_tables(spark):
    for name in JOINING:
        text = plan(contract.queries()[name](spark, SF_DIR))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_row_wise_work_is_not_shuffled(spark):
    entries = documents(spark, SF_DIR)
    ids = entries.withColumn("ids", fx.token_ids(F.col("text")))
    for df in (
        tokenize(entries),
        osc.classify(ids, fx.COLUMN_SCORER, fx.LABELS),
        osc.classify_detailed(ids, fx.COLUMN_SCORER, fx.LABELS),
    ):
        assert "Exchange" not in plan(df)


def test_keywords_read_and_filter_at_the_scan(tokens):
    text = plan(keyword_tokens(tokens, fx.LEXICON))
    assert re.search(r"PushedFilters: \[.*In\(pos, \[", text)
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert "head" not in schema and "dep" not in schema and "ws" not in schema


def test_clause_seeds_filter_both_sides_at_the_scan(tokens):
    text = plan(clause_seeds(tokens, fx.LEXICON))
    assert re.search(r"PushedFilters: \[.*In\(pos, \[", text)
    assert re.search(r"PushedFilters: \[.*In\(dep, \[", text)


def test_words_that_start_no_phrase_are_not_shuffled(spark, tokens):
    """Votes leave a task only for whole phrases and for those cut at the end of a stretch."""
    text = plan(match_phrases(tokens, fx.LEXICON))
    assert text.index("partial_sum") > text.index("Exchange hashpartitioning")
    places = phrase_places(fx.LEXICON)
    longest = max(p[2] for p in places)
    rows = tokens.select("entry_id", "tok_no", "lemma").sort("entry_id", "tok_no").toArrow()
    votes = list(vote_in_place(places)(iter(rows.to_batches(max_chunksize=10_000))))
    sent = sum(v.num_rows for v in votes)
    single = sum(lemma in {p[4] for p in places} for lemma in rows.column("lemma").to_pylist())
    matches = match_phrases(tokens, fx.LEXICON).count()
    n_entries = tokens.select("entry_id").distinct().count()
    assert sent <= matches + 2 * longest * len(fx.LEXICON.phrases()) * (n_entries + len(votes))
    whole = sum((v.column("votes").to_numpy() == v.column("n_lemmas").to_numpy()).sum() for v in votes)
    assert whole <= matches and single >= matches


@pytest.mark.parametrize("split", ["sorted", "scattered", "one row each"])
def test_phrases_do_not_depend_on_the_order_of_the_table(spark, split):
    rng = random.Random(2)
    lexicon = replace(PORTUGUESE, emotion_phrases={"a": [["no", "de", "no"], ["de"], ["x", "de"]], "b": [["no", "no"], ["de", "no", "x", "x"]]})
    rows = []
    for entry in (1, 2, None, 3):
        rows += [(entry, 1 + t // 3, t + 1, rng.choice(["no", "de", "x", "y"])) for t in range(400) if t % 97]
    expected = set()
    for entry in (1, 2, None, 3):
        lemma = {t: x for e, _, t, x in rows if e == entry}
        for no, category, phrase in lexicon.phrases():
            for t in lemma:
                if all(lemma.get(t + k) == x for k, x in enumerate(phrase)):
                    expected.add((entry, no, category, t, t + len(phrase)))
    df = spark.createDataFrame(rows, "entry_id bigint, sent_no int, tok_no int, lemma string")
    df = {"sorted": df.coalesce(1), "scattered": df.repartition(7), "one row each": df.repartition(64, "tok_no")}[split]
    got = match_phrases(df, lexicon).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_top_terms_are_limited_before_the_shuffle(stored):
    text = plan(top_terms(term_frequency(stored)))
    assert re.search(r"WindowGroupLimit .* Partial", text)
    assert "ReadSchema: struct<persona:string,keywords:string>" in text


@pytest.mark.parametrize("ranges", [8, 5000])
def test_numbers_take_one_scan_and_one_exchange_of_the_rows(spark, ranges):
    rows = documents(spark, SF_DIR).select("entry_id", "persona")
    assert jobs(spark, lambda: running_number(rows, "n", "entry_id", ["persona"], ranges)) == 0
    text = executed_plan(running_number(rows, "n", "entry_id", ["persona"], 8 if ranges == 8 else 64))
    assert text.count("Scan parquet") == 1 and text.count("- Exchange rangepartitioning(persona") == 1
    assert "ReusedExchange" in text and "CASE WHEN (entry_id" not in text
    grid = rows.selectExpr("entry_id AS grid_no", "persona AS text")
    assert jobs(spark, lambda: assign_ids(grid)) == 0
    assert executed_plan(assign_ids(grid)).count("- Exchange rangepartitioning(grid_no") == 1


def executed_plan(df) -> str:
    """The adaptive plan after a run, its final part only."""
    rows = df._jdf.queryExecution()
    rows.executedPlan().execute().count()
    text = rows.executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def jobs(spark, build) -> int:
    """How many jobs run while a DataFrame is built."""
    spark.sparkContext.setJobGroup("build", "build")
    build()
    ids = spark.sparkContext.statusTracker().getJobIdsForGroup("build")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(ids)


def test_clauses_run_no_job_while_they_are_planned(spark, tokens):
    entries = documents(spark, SF_DIR)
    ids = fx.token_ids(F.col("text"))
    assert jobs(spark, lambda: clauses(tokens, fx.LEXICON)) == 0
    assert jobs(spark, lambda: subtree_text(tokens, clause_seeds(tokens, fx.LEXICON))) == 0
    assert jobs(spark, lambda: enrich(entries, tokens, ids, fx.COLUMN_SCORER, fx.LABELS, fx.LEXICON)) == 0


def test_records_read_the_tokens_once(spark, tokens):
    ids = fx.token_ids(F.col("text"))
    entries = documents(spark, SF_DIR)
    for df in (
        enrich(entries, tokens, ids, fx.COLUMN_SCORER, fx.LABELS, fx.LEXICON),
        enrich(entries, tokens, ids, fx.batch_scorer(), fx.LABELS, fx.LEXICON),
        extract_records(entries, tokens, fx.LEXICON),
    ):
        assert plan(df).count("plan-tokens") == 1


def test_python_scorer_reads_and_tokenizes_once(spark):
    ids = documents(spark, SF_DIR).withColumn("ids", fx.token_ids(F.col("text")))
    for df in (
        osc.classify(ids.select("entry_id", "ids"), fx.batch_scorer(), fx.LABELS),
        osc.classify_detailed(ids.select("entry_id", "ids"), fx.batch_scorer(), fx.LABELS),
    ):
        text = plan(df)
        assert text.count("Scan parquet") == 1 and text.count("regexp_extract_all") == 1
        assert text.count("Exchange") == 2


def test_gold_and_lemmas_are_joined_without_a_probe(spark, stored, tmp_path):
    spark.createDataFrame([(1, "NEUTRAL")], "entry_id bigint, expected string").write.parquet(str(tmp_path / "gold"))
    gold = spark.read.parquet(str(tmp_path / "gold"))
    assert jobs(spark, lambda: attach_gold(stored, gold, "entry_id")) == 0
    assert "BroadcastHashJoin" in plan(attach_gold(stored, gold, "entry_id"))
    lemmas = gold.selectExpr("expected AS form", "expected AS lemma")
    entries = documents(spark, SF_DIR)
    assert jobs(spark, lambda: tokenize(entries, lemmas)) == 0


def test_personas_are_counted_before_they_meet_the_gold(spark, stored):
    text = plan(persona_pair_counts(stored, gold_table(spark)))
    join = text.index("BroadcastHashJoin")
    assert "HashAggregate(keys=[persona" in text[join:]
    assert "LocalTableScan" in text


def test_views_and_metrics_run_no_job_while_they_are_planned(spark, stored):
    gold = gold_table(spark)
    for build in (
        lambda: evaluate(stored, gold),
        lambda: evaluation_summary(stored, gold),
        lambda: persona_views(stored),
        lambda: persona_view_rows(stored),
        lambda: timeline.record_for_day(stored, 3),
    ):
        assert jobs(spark, build) == 0
    text = plan(evaluation_summary(stored, gold))
    assert text.count("Scan parquet") == 1 and "Union" not in text


def test_evaluation_tables_count_the_corpus_once_each(spark, tmp_path):
    labels = ["POSITIVE", "NEGATIVE", "NEUTRAL"]
    rows = [(i, f"Persona_{'ABCDE'[i % 5]}", *["t"] * 7, labels[i % 3], "k") for i in range(60)]
    spark.createDataFrame(rows, PROCESSED).write.parquet(f"{tmp_path}/processed")
    processed = corpus.read_processed(spark, f"{tmp_path}/processed")
    for name, table in evaluate(processed, gold_table(spark)).items():
        assert executed_plan(table).count("Scan parquet") == 1, name
