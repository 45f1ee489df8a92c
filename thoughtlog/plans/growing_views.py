"""Views of a corpus that grows: each batch of new entries is counted once and kept as counts.

A folder holds, for every batch, partial counts that add up (labels, emotions, terms), the numbered
calendar rows of its entries, and how many entries each persona has had. Adding a batch reads only
its own entries and the small table of earlier counts; a day number is the number inside the
batch plus the persona's earlier entries. The views are sums over the batches. Writing a batch
again replaces it, so a job that failed half-way is simply run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thoughtlog.operators import timeline as tl
from thoughtlog.operators.keywords import TOP_TERMS, term_frequency, top_terms
from thoughtlog.operators.numbering import day_number
from thoughtlog.sources.scratch import exists

TABLES = {
    "polarities": "persona string, polarity string, n bigint",
    "emotions": "persona string, emotion string, n bigint",
    "terms": "persona string, term string, n bigint",
    "calendar": "entry_id bigint, persona string, polarity string, day_no bigint",
    "personas": "persona string, n bigint, last bigint",
}

#: Raised where a batch has entries that should have come before stored ones.
TOO_LATE = "an entry of this batch does not follow the stored entries of its persona"


def _stored(spark: SparkSession, path: str, table: str) -> DataFrame:
    schema = f"{TABLES[table]}, batch string"
    if not exists(spark, f"{path}/{table}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{table}")


def batch_tables(processed: DataFrame, earlier: DataFrame) -> dict[str, DataFrame]:
    """What a batch adds, by table. ``earlier`` has ``persona, n, last``: how many entries a persona
    had before, and the largest id among them; an entry that does not follow it raises."""
    numbered = day_number(processed.select("entry_id", "persona", "polarity"))
    known = numbered.join(earlier.select("persona", F.col("n").alias("_before"), "last"), "persona", "left")
    late = F.col("last").isNotNull() & (F.col("entry_id") <= F.col("last"))
    day = F.col("day_no") + F.coalesce("_before", F.lit(0))
    checked = F.when(late, F.raise_error(F.lit(TOO_LATE)).cast("long")).otherwise(day)
    return {
        "polarities": tl.polarity_counts(processed),
        "emotions": tl.emotion_frequency(processed, ordered=False),
        "terms": term_frequency(processed),
        "calendar": known.select("entry_id", "persona", "polarity", checked.alias("day_no")),
        "personas": processed.where("entry_id IS NOT NULL").groupBy("persona").agg(F.count("*").alias("n"), F.max("entry_id").alias("last")),
    }


def add_batch(processed: DataFrame, path: str, batch: str) -> None:
    """Count the entries of a batch and store the counts in the folder.

    Entries of a persona must have larger ids than those of its other batches, as ids are given in
    the order of arrival. Only the given entries are read, and of the stored ones a row per
    persona and batch. ``personas`` is written last: a batch without it was not finished.
    """
    spark = processed.sparkSession
    others = _stored(spark, path, "personas").where(F.col("batch") != batch)
    earlier = others.groupBy("persona").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    for table, rows in batch_tables(processed, earlier).items():
        rows.write.mode("overwrite").parquet(f"{path}/{table}/batch={batch}")


def read_views(spark: SparkSession, path: str, k: int = TOP_TERMS, ordered: bool = True) -> dict[str, DataFrame]:
    """The tables of :func:`thoughtlog.plans.persona_views.persona_views` over all finished batches."""
    finished = _stored(spark, path, "personas").select("batch").distinct()

    def rows(table: str) -> DataFrame:
        return _stored(spark, path, table).join(finished, "batch", "left_semi")

    def summed(table: str, *keys: str) -> DataFrame:
        return rows(table).groupBy(*keys).agg(F.sum("n").alias("n"))

    calendar = tl.with_calendar(rows("calendar").drop("batch"))
    emotions = summed("emotions", "persona", "emotion")
    return {
        "personas": tl.persona_list(rows("polarities")),
        "summary": tl.summary_of_counts(rows("polarities")),
        "emotions": emotions.orderBy("persona", F.desc("n"), "emotion") if ordered else emotions,
        "heatmap": tl.mood_heatmap(calendar),
        "series": tl.polarity_series(calendar, ordered),
        "terms": top_terms(summed("terms", "persona", "term"), k),
    }
