"""One query per operator over the ``documents``, ``labels`` and ``conversations`` tables.

Documents are entries (their source is the persona), conversations are a second corpus. The
annotator, the scorer and the word lists are the rule-made test doubles of
``thoughtlog.testing``. Every query reads its tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thoughtlog.functions import scores as fs
from thoughtlog.functions import text as ft
from thoughtlog.functions.windows import frame_window, window_count
from thoughtlog.operators import clauses as oc
from thoughtlog.operators import evaluation as ev
from thoughtlog.operators import keywords as ok
from thoughtlog.operators import numbering as on
from thoughtlog.operators import phrases as op
from thoughtlog.operators import prompts as opr
from thoughtlog.operators import records as orc
from thoughtlog.operators import scoring as osc
from thoughtlog.operators import timeline as tl
from thoughtlog.operators import tokens as ot
from thoughtlog.operators.windows import token_windows
from thoughtlog.plans.enrich import attach_results, enrich, extract_records
from thoughtlog.plans.evaluate import evaluate, evaluation_summary
from thoughtlog.plans.growing_views import add_batch, read_views
from thoughtlog.plans.persona_views import long_rows, persona_view_rows
from thoughtlog.sources import corpus
from thoughtlog.sources.gold import gold_table
from thoughtlog.sources.lexicons import lexicon_tables
from thoughtlog.sources.scratch import fresh_path, materialize
from thoughtlog.sources.spread import parts, spread_if_few
from thoughtlog.testing import fixture_pack as fx

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def _plain(column: Column, kind: T.DataType) -> Column:
    """Comparable form of a column: long integers, rounded doubles, joined arrays."""
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.DoubleType, T.FloatType)):
            column = F.transform(column, lambda x: F.format_string("%.6f", x))
        return F.array_join(column.cast("array<string>"), " ")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.round(column, 6)
    if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
        return column.cast("long")
    return column


def _query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = function(spark, sf_dir)
        return df.select([_plain(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])

    QUERIES[function.__name__] = run
    return run


# Inputs


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        F.col("doc_id").alias("entry_id"), F.col("source").alias("persona"), "text"
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for work on their texts, over all cores."""
    return spread_if_few(documents(spark, sf_dir), "entry_id")


def dealt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents dealt by entry. Their tokens are many times larger and, made where the texts
    lie, need no shuffle to be grouped by sentence or entry."""
    rows = documents(spark, sf_dir)
    return rows.repartition(parts(rows), "entry_id")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.annotate(texts(spark, sf_dir))


def stored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token table, stored in buckets of entries."""
    rows = fx.annotate(dealt_texts(spark, sf_dir))
    path = fresh_path(spark, "tokens")
    table = f"tokens_{path[-32:]}"
    corpus.write_bucketed(rows, table, parts(documents(spark, sf_dir)), dealt=True, path=path)
    return corpus.read_bucketed(spark, table)


def with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).withColumn("ids", fx.token_ids(F.col("text")))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osc.entry_logits(with_ids(spark, sf_dir), fx.COLUMN_SCORER)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their polarity, labelled where they lie."""
    ids = fx.token_ids(F.col("text"))
    label = osc.polarity_column(ids, fx.COLUMN_SCORER, fx.LABELS)
    return texts(spark, sf_dir).withColumn("polarity", label)


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.with_calendar(on.day_number(classified(spark, sf_dir).drop("text")))


def entry_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    expected = (
        F.when(F.col("toxic") == 1, "NEGATIVE")
        .when(F.col("quality") == 1, "POSITIVE")
        .otherwise("NEUTRAL")
    )
    return labels.select(F.col("doc_id").alias("entry_id"), expected.alias("expected"))


def persona_gold(spark: SparkSession) -> DataFrame:
    return gold_table(spark, fx.GOLD)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = classified(spark, sf_dir).drop("text")
    return ev.valid_pairs(ev.attach_gold(labelled, entry_gold(spark, sf_dir), "entry_id"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.pair_counts(pairs(spark, sf_dir))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.per_class_report(counts(spark, sf_dir))


def emotions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with its emotion field."""
    found = op.emotion_set(op.match_phrases(tokens(spark, sf_dir), fx.LEXICON))
    entries = attach_results(documents(spark, sf_dir).drop("text"), found)
    return entries.fillna("Falta léxico.", subset=["emotions"])


def keywords_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with its keyword string, null where there is none."""
    found = ok.keywords(tokens(spark, sf_dir), fx.LEXICON)
    return attach_results(documents(spark, sf_dir).drop("text"), found)


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = dealt_texts(spark, sf_dir)
    return enrich(
        entries,
        fx.annotate(entries),
        fx.token_ids(F.col("text")),
        fx.COLUMN_SCORER,
        fx.LABELS,
        fx.LEXICON,
    )


# Sources and sinks


@_query
def read_corpus_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "corpus-csv")
    corpus.write_corpus(documents(spark, sf_dir), path, "csv")
    return corpus.read_corpus(spark, path, "csv")


@_query
def read_corpus_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "corpus")
    corpus.write_corpus(documents(spark, sf_dir), path)
    return corpus.read_corpus(spark, path)


@_query
def read_processed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "processed-csv")
    corpus.write_processed(processed(spark, sf_dir), path, "csv")
    return corpus.read_processed(spark, path, "csv").drop("text")


@_query
def read_processed_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "processed")
    corpus.write_processed(processed(spark, sf_dir), path)
    return corpus.read_processed(spark, path).drop("text")


@_query
def word_list_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lexicon_tables(spark, fx.LEXICON)["words"]
    hits = tokens(spark, sf_dir).select(F.col("lemma").alias("word")).join(words, "word")
    return hits.groupBy("list", "word").agg(F.count("*").alias("n_tokens"))


@_query
def gold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_persona = documents(spark, sf_dir).groupBy("persona").agg(F.count("*").alias("n_entries"))
    return ev.attach_gold(per_persona, persona_gold(spark))


@_query
def read_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    tokens(spark, sf_dir).write.parquet(path)
    return corpus.read_tokens(spark, path)


@_query
def annotate_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tokens from a Python annotator."""
    return ot.annotate(texts(spark, sf_dir), fx.batch_annotator())


def reversed_lemmas(entries: DataFrame) -> DataFrame:
    """An annotator whose lemmas are unlike the words: backwards, in lower case."""
    return fx.annotate(entries).withColumn("lemma", F.reverse("lemma"))


@_query
def match_lemmatised_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = op.lemmatised(spark, fx.LEXICON, reversed_lemmas)
    return op.match_phrases(reversed_lemmas(texts(spark, sf_dir)), lexicon)


@_query
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ot.tokenize(texts(spark, sf_dir)).select(
        "entry_id", "sent_no", "tok_no", "text", "lemma"
    )


def singular_forms(forms: DataFrame) -> DataFrame:
    """``form, lemma`` of the forms that end in s and have a twin without it. Forms and their stems
    meet in one grouping, so that the texts behind the forms are read once."""
    form = F.col("form")
    stem = F.when(form.endswith("s"), F.struct(F.expr("left(form, length(form) - 1)").alias("lemma"), F.lit(True).alias("cut")))
    both = F.array_compact(F.array(F.struct(form.alias("lemma"), F.lit(False).alias("cut")), stem))
    met = forms.select(F.inline(both)).groupBy("lemma").agg(F.min("cut").alias("own"), F.max("cut").alias("longer"))
    return met.where(~F.col("own") & F.col("longer")).select(F.concat("lemma", F.lit("s")).alias("form"), "lemma")


@_query
def tokenize_with_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemma table made from the corpus: a form that ends in s and has a twin without it."""
    forms = ot.tokenize(texts(spark, sf_dir)).select(F.col("lemma").alias("form")).distinct()
    lemmas = materialize(singular_forms(forms), "lemmas")
    rows = ot.tokenize(dealt_texts(spark, sf_dir), lemmas)
    return rows.groupBy("entry_id", "lemma").agg(F.count("*").alias("n"))


# Projections, filters, scalar functions


@_query
def time_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = ft.time_anchor(F.col("text"), fx.LEXICON.time_words)
    return texts(spark, sf_dir).select("entry_id", anchor.alias("time_anchor"))


@_query
def time_anchor_portuguese(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations(spark, sf_dir)
    return turns.select("conv_id", "turn", ft.time_anchor(F.col("text")).alias("time_anchor"))


@_query
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ot.split_sentences(texts(spark, sf_dir))


@_query
def sentence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ot.sentence_texts(fx.annotate(dealt_texts(spark, sf_dir)))


@_query
def context_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ot.context_sentences(tokens(spark, sf_dir), fx.LEXICON)


@_query
def person_place_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ot.person_place_entities(tokens(spark, sf_dir))


@_query
def default_when_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.regexp_extract_all(F.col("text"), F.lit(r"\d+"), F.lit(0))
    field = ft.default_when_empty(hits, " | ", "Sem reação.")
    return texts(spark, sf_dir).select("entry_id", field.alias("field"))


@_query
def capitalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ot.split_sentences(texts(spark, sf_dir))
    return rows.select("entry_id", "sent_no", ft.capitalize(F.col("sentence")).alias("sentence"))


@_query
def min_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ot.split_sentences(texts(spark, sf_dir))
    return rows.select("entry_id", "sent_no", ft.word_count(F.col("sentence")).alias("n_words")).where(
        F.col("n_words") > oc.THOUGHT_WORDS
    )


@_query
def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = conversations(spark, sf_dir).select(
        "conv_id", "turn", F.posexplode(F.split("text", "[.]"))
    )
    return lines.select("conv_id", "turn", "pos", ft.strip(F.col("col")).alias("piece"))


@_query
def label_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {0: "negative", 2: "positive"}
    rows = osc.classify(with_ids(spark, sf_dir), fx.COLUMN_SCORER, known)
    return rows.withColumnRenamed("polarity", "label")


@_query
def polarity_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classified(spark, sf_dir)
    return rows.select("entry_id", fs.polarity_value(F.col("polarity")).alias("value"))


@_query
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = tl.with_calendar(
        on.day_number(documents(spark, sf_dir).select("entry_id", "persona")).withColumn(
            "polarity", F.lit(None).cast("string")
        )
    )
    return days.select("entry_id", "persona", "day_no", "week_no", "day_of_week")


@_query
def persona_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.persona_slice(classified(spark, sf_dir).drop("text"), "src3")


@_query
def translate_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classified(spark, sf_dir)
    return rows.select("entry_id", ft.translate_label(F.col("polarity")).alias("name"))


@_query
def prediction_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    older = classified(spark, sf_dir).withColumnRenamed("polarity", "polarity_old")
    return older.groupBy(F.col(ev.prediction_column(older)).alias("label")).agg(
        F.count("*").alias("n")
    )


@_query
def valid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


@_query
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ok.keyword_tokens(tokens(spark, sf_dir), fx.LEXICON)


@_query
def card_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orc.triggers(tokens(spark, sf_dir)).select(
        "entry_id", F.replace("triggers", F.lit(", "), F.lit(" | ")).alias("field")
    )
    return rows.select("entry_id", ft.card_text(F.col("field")).alias("card"))


@_query
def matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = ev.confusion_matrix(counts(spark, sf_dir))
    return ev.matrix_cells(ev.confusion_normalized(matrix))


# Joins


@_query
def match_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.match_phrases(tokens(spark, sf_dir), fx.LEXICON)


@_query
def thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc.thoughts(stored_tokens(spark, sf_dir), fx.LEXICON)


@_query
def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc.reactions(stored_tokens(spark, sf_dir), fx.LEXICON)


@_query
def subtree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_tokens(spark, sf_dir)
    return oc.subtree_text(rows, oc.clause_seeds(rows, fx.LEXICON))


@_query
def subtree_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_tokens(spark, sf_dir)
    return oc.subtree_members(rows, oc.clause_seeds(rows, fx.LEXICON))


@_query
def attach_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.attach_gold(documents(spark, sf_dir).drop("text"), persona_gold(spark))


@_query
def attach_entry_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = documents(spark, sf_dir).drop("text")
    return ev.attach_gold(entries, entry_gold(spark, sf_dir), "entry_id")


@_query
def unknown_personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.unknown_personas(documents(spark, sf_dir), persona_gold(spark))


@_query
def attach_results_by_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens(spark, sf_dir)
    return attach_results(
        documents(spark, sf_dir).drop("text"),
        op.emotion_set(op.match_phrases(rows, fx.LEXICON)),
        orc.triggers(rows),
        osc.classify(with_ids(spark, sf_dir), fx.COLUMN_SCORER, fx.LABELS),
    )


def _conversation_personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        conversations(spark, sf_dir)
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("prompt"))
        .select(
            F.col("conv_id").alias("persona_no"),
            F.concat(F.lit("conv"), "conv_id").alias("persona"),
            "prompt",
        )
    )


@_query
def prompt_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opr.prompt_grid(_conversation_personas(spark, sf_dir))


# Sliding windows and scores


@_query
def token_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_windows(with_ids(spark, sf_dir))


@_query
def token_windows_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_windows(with_ids(spark, sf_dir), 20, 8).drop("ids")


@_query
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = window_count(F.size("ids"))
    return with_ids(spark, sf_dir).select("entry_id", n.alias("n_windows"))


@_query
def framed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_windows(with_ids(spark, sf_dir))
    return rows.select("entry_id", "window_no", frame_window(F.col("ids"), 0, 2).alias("ids"))


@_query
def score_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osc.score_windows(token_windows(with_ids(spark, sf_dir)), fx.COLUMN_SCORER)


@_query
def score_windows_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osc.score_windows(token_windows(with_ids(spark, sf_dir)), fx.batch_scorer())


@_query
def mean_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = osc.score_windows(token_windows(with_ids(spark, sf_dir)), fx.COLUMN_SCORER)
    return osc.mean_logits(scores)


@_query
def mean_logits_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir)


@_query
def argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).select("entry_id", fs.argmax(F.col("logits")).alias("winner"))


@_query
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("logits", lambda x: x / 100)
    return logits(spark, sf_dir).select(
        "entry_id",
        fs.softmax(scaled).alias("probabilities"),
        fs.confidence(scaled).alias("confidence"),
    )


@_query
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osc.classify(with_ids(spark, sf_dir), fx.COLUMN_SCORER, fx.LABELS)


@_query
def classify_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osc.classify(with_ids(spark, sf_dir), fx.batch_scorer(), fx.LABELS)


@_query
def classify_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osc.classify_detailed(with_ids(spark, sf_dir), fx.COLUMN_SCORER, fx.LABELS)


# Aggregations


TWO_LABELS = {0: "negative", 1: "positive"}  # the last class of the scorer has none


@_query
def classify_last_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osc.classify(with_ids(spark, sf_dir), fx.COLUMN_SCORER, TWO_LABELS)


@_query
def classify_python_last_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osc.classify(with_ids(spark, sf_dir), fx.batch_scorer(), TWO_LABELS)


@_query
def classify_detailed_last_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = osc.classify_detailed(with_ids(spark, sf_dir), fx.batch_scorer(), TWO_LABELS)
    return rows.select("entry_id", "polarity", "logits", "n_windows")


@_query
def emotion_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.emotion_set(op.match_phrases(tokens(spark, sf_dir), fx.LEXICON))


@_query
def situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc.situations(tokens(spark, sf_dir), fx.LEXICON)


@_query
def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc.triggers(tokens(spark, sf_dir))


@_query
def ordered_distinct_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ot.split_sentences(texts(spark, sf_dir))
    pairs_of = F.collect_list(F.struct(F.col("sent_no").alias("ord"), F.col("sentence").alias("value")))
    return rows.groupBy("entry_id").agg(
        F.array_join(ft.ordered_distinct(pairs_of), " | ").alias("sentences")
    )


@_query
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ok.keywords(tokens(spark, sf_dir), fx.LEXICON)


@_query
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ok.term_frequency(keywords_of(spark, sf_dir))


@_query
def emotion_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.emotion_frequency(emotions_of(spark, sf_dir))


@_query
def polarity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.polarity_summary(classified(spark, sf_dir))


@_query
def mood_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.mood_heatmap(numbered(spark, sf_dir))


@_query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion_matrix(counts(spark, sf_dir))


@_query
def canonical_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with one more label that is not in the canon, on the side of the prediction."""
    mixed = F.when(F.col("entry_id") % 7 == 0, "MIXED").otherwise(F.col("polarity"))
    labelled = classified(spark, sf_dir).select("entry_id", mixed.alias("polarity"))
    return evaluate(labelled, entry_gold(spark, sf_dir), "entry_id")["canonical_matrix"]


@_query
def evaluation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = classified(spark, sf_dir).drop("text")
    return evaluate(labelled, entry_gold(spark, sf_dir), "entry_id")["links"]


@_query
def confusion_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion_normalized(ev.confusion_matrix(counts(spark, sf_dir)))


@_query
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.accuracy(counts(spark, sf_dir))


@_query
def per_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir)


@_query
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.macro_metrics(report(spark, sf_dir))


@_query
def weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.weighted_metrics(report(spark, sf_dir))


@_query
def class_metric_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.class_metric_bars(report(spark, sf_dir))


@_query
def flow_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.flow_links(counts(spark, sf_dir))


# Window functions


@_query
def day_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on.day_number(documents(spark, sf_dir).select("entry_id", "persona"))


@_query
def day_number_small_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = documents(spark, sf_dir).select("entry_id", "persona")
    return on.running_number(entries, "day_no", "entry_id", ["persona"], ranges=40)


@_query
def day_number_sparse_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids far apart, every fifth one null."""
    spread = F.when(F.col("entry_id") % 5 != 0, F.col("entry_id") * 1_000_003)
    entries = documents(spark, sf_dir).select(spread.alias("entry_id"), "persona")
    return on.day_number(entries)


@_query
def day_number_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations(spark, sf_dir).select("conv_id", "turn", "role")
    return on.running_number(turns, "day_no", "turn", ["conv_id", "role"])


@_query
def number_pages_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running number over the whole table by a text key."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat_ws("#", "url", "page_id").alias("place"))
    return on.running_number(pages, "no", "place")


@_query
def number_events_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user by their time, ties by id."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    return on.running_number(events, "no", ["ts", "event_id"], ["user_id"]).select("event_id", "user_id", "no")


@_query
def number_orders_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each priority by date and price, as many ranges as ten times the partitions."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    keys = ["o_orderdate", "o_totalprice", "o_orderkey"]
    return on.running_number(orders, "no", keys, ["o_orderpriority"], ranges=80).select("o_orderkey", "o_orderpriority", "no")


@_query
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the grid whose turn exists in the conversation; the others failed."""
    grid = opr.prompt_grid(_conversation_personas(spark, sf_dir)).drop("request")
    turns = conversations(spark, sf_dir).select(
        F.col("conv_id").alias("persona_no"),
        (F.col("turn") + 1).alias("day"),
        ft.strip(F.col("text")).alias("text"),
    )
    return on.assign_ids(grid.join(turns, ["persona_no", "day"], "left"))


@_query
def polarity_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.polarity_series(numbered(spark, sf_dir))


# Sort, top-k, sets


@_query
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ok.top_terms(ok.term_frequency(keywords_of(spark, sf_dir)))


@_query
def top_terms_by_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with rare pairs left out before counts are shuffled."""
    return ok.frequent_terms(materialize(keywords_of(spark, sf_dir), "keywords"))


@_query
def persona_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.persona_list(documents(spark, sf_dir))


@_query
def record_for_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.record_for_day(materialize(processed(spark, sf_dir), "processed"), 3)


@_query
def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.label_union(counts(spark, sf_dir))


@_query
def present_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.present_classes(counts(spark, sf_dir), ("MIXED", "NEGATIVE", "NEUTRAL", "POSITIVE"))


# Whole jobs


@_query
def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = dealt_texts(spark, sf_dir)
    return extract_records(entries, fx.annotate(entries), fx.LEXICON)


@_query
def enriched_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processed(spark, sf_dir).drop("text")


@_query
def enriched_corpus_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = dealt_texts(spark, sf_dir)
    return enrich(
        entries,
        fx.annotate(entries),
        fx.token_ids(F.col("text")),
        fx.batch_scorer(),
        fx.LABELS,
        fx.LEXICON,
    ).drop("text")


@_query
def evaluation_by_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = classified(spark, sf_dir).drop("text")
    return evaluation_summary(labelled, entry_gold(spark, sf_dir), "entry_id")


@_query
def evaluation_by_persona(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation_summary(classified(spark, sf_dir).drop("text"), persona_gold(spark))


@_query
def persona_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persona_view_rows(materialize(processed(spark, sf_dir), "processed"))


@_query
def persona_views_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views after the last third of the entries was added to those of the first two, in two
    batches of its own."""
    whole = materialize(processed(spark, sf_dir), "processed")
    path = fresh_path(spark, "views")
    third = whole.agg(F.max("entry_id")).first()[0] * 2 // 3
    for batch, rows in {
        "first": whole.where(F.col("entry_id") <= third),
        "second": whole.where((F.col("entry_id") > third) & (F.col("entry_id") <= third + third // 4)),
        "third": whole.where(F.col("entry_id") > third + third // 4),
    }.items():
        add_batch(rows, path, batch)
    return long_rows(read_views(spark, path, ordered=False))


@_query
def polarity_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: texts to ids, windows, scores, labels, and label shares per persona."""
    shares = tl.polarity_summary(classified(spark, sf_dir))
    return shares.select("persona", "total", "share_positive", "share_negative", "share_neutral")
