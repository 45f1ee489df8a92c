"""Content words of entries and their frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thoughtlog.operators.membership import drop_members, member
from thoughtlog.sources.lexicons import PORTUGUESE, Lexicon

# Parts of speech of content words, and the term count of a word cloud.
CONTENT_POS = ("NOUN", "ADJ", "ADV")
MIN_LENGTH = 3
TOP_TERMS = 70


def _is_content() -> Column:
    return (
        F.col("pos").isin(*CONTENT_POS)
        & ~F.col("is_stop")
        & (F.length("lemma") >= MIN_LENGTH)
    )


def is_keyword(lexicon: Lexicon = PORTUGUESE) -> Column:
    """Whether a token is a content word that is neither short nor a stop word."""
    return _is_content() & ~member(F.lower("lemma"), lexicon.stopwords)


def keyword_tokens(tokens: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """``entry_id, tok_no, keyword`` of content words that are neither short nor stop words."""
    content = tokens.where(_is_content()).select("entry_id", "tok_no", F.lower("lemma").alias("keyword"))
    return drop_members(content, F.col("keyword"), lexicon.stopwords)


def keywords(tokens: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """``entry_id, keywords``: content words in text order, repeats kept."""
    pairs = F.array_sort(F.collect_list(F.struct("tok_no", "keyword")))
    return (
        keyword_tokens(tokens, lexicon)
        .groupBy("entry_id")
        .agg(
            F.array_join(F.transform(pairs, lambda p: p["keyword"]), " ").alias("keywords")
        )
    )


def _terms(processed: DataFrame) -> DataFrame:
    """``persona, term``, a row per occurrence."""
    terms = processed.select("persona", F.explode(F.split("keywords", " ")).alias("term"))
    return terms.where(F.col("term") != "")


def term_frequency(processed: DataFrame) -> DataFrame:
    """``persona, term, n`` over the keyword strings; null strings count nothing."""
    return _terms(processed).groupBy("persona", "term").agg(F.count("*").alias("n"))


def top_terms(frequencies: DataFrame, k: int = TOP_TERMS) -> DataFrame:
    """``persona, term, n, rank``: the k most frequent terms of each persona.

    The rank filter is pushed below the shuffle, so each task sends at most k rows per
    persona however many terms a persona has.
    """
    order = Window.partitionBy("persona").orderBy(F.desc("n"), F.asc("term"))
    return frequencies.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k
    )


def frequent_terms(
    processed: DataFrame, k: int = TOP_TERMS, part: int = 16, buckets: int = 1 << 18, personas: int = 100_000
) -> DataFrame:
    """As :func:`top_terms` of all terms, for corpora in which most (persona, term) pairs are rare.

    Two bounds are found first. A term is at least as frequent as in one of ``part`` parts of the
    entries, so the k-th count there is one that the k-th count over all reaches too. And it is at
    most as frequent as all pairs that share its bucket of a hash, which is a sketch of one number
    per bucket. Pairs whose bucket does not reach their persona's bound are left out before the
    counts are shuffled; the others are counted exactly, so the rows are the same, ties included.

    Bounds are kept for the personas with the ``personas`` greatest ones; all pairs of others are
    counted. Both tables have a stated size, so they are sent to the tasks. ``processed`` needs
    ``entry_id`` and is read three times.
    """
    in_part = F.pmod(F.xxhash64("entry_id"), F.lit(part)) == 0
    ranked = top_terms(term_frequency(processed.where(in_part)), k)
    bounds = ranked.where((F.col("rank") == k) & (F.col("n") > 1) & F.col("persona").isNotNull())
    bounds = bounds.orderBy(F.desc("n"), "persona").limit(personas).select("persona", F.col("n").alias("_least"))
    bucket = F.pmod(F.xxhash64("persona", "term"), F.lit(buckets)).alias("_bucket")
    terms = _terms(processed).select("persona", "term", bucket)
    sketch = terms.groupBy("_bucket").agg(F.count("*").alias("_most"))
    known = terms.join(F.broadcast(bounds), "persona", "left").join(F.broadcast(sketch), "_bucket")
    kept = known.where(F.col("_least").isNull() | (F.col("_most") >= F.col("_least")))
    return top_terms(kept.groupBy("persona", "term").agg(F.count("*").alias("n")), k)
