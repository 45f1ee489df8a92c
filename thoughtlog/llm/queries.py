"""One query for each operator, over its whole table, in the form fixed for its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thoughtlog.functions.binding import bind
from thoughtlog.llm import backoff, decontaminate, language_id, line_dedup, packing, periodic_runs, secret_scan, simhash, spelling, substring_dedup, token_files, toxicity, winnowing
from thoughtlog.sources.scratch import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document under links of at most two differing fingerprint bits."""
    groups = simhash.near_duplicate_groups(documents(spark, sf_dir))
    return groups.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept of every document after lines of at least five documents lost all but one."""
    return line_dedup.drop_repeated_lines(documents(spark, sf_dir), digest=True)


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words found in every document."""
    hits = decontaminate.find_windows(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4,096 tokens."""
    return packing.pack(documents(spark, sf_dir), vocabulary())


@query
def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited form and the next document. The hashes are written
    in base 64, as they are several times the texts: in all their bits, with two thirds of the digits."""
    found = winnowing.compare_edited(documents(spark, sf_dir), winnowing.DENSE_GRAM, winnowing.DENSE_WINDOW)
    digits = {name: F.base64(F.unhex(name)) for name in ("fingerprint", "edited_fingerprint")}
    return found.withColumns({name: F.translate(x, "\r\n", "") for name, x in digits.items()})


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from documents that are not held out."""
    docs = documents(spark, sf_dir)
    model = language_id.learn(docs)
    marked = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    return language_id.identify(marked, model).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept of every document after repeated passages of 35 words are gone."""
    return substring_dedup.remove_repeated(documents(spark, sf_dir), digest=True)


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as Huffman-coded files and read back."""
    path = fresh_path(spark, "token-files")
    token_files.write_tokens(documents(spark, sf_dir), vocabulary(), path)
    back = token_files.read_tokens(spark, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: fixed patterns and words that look drawn at random."""
    found = secret_scan.scan(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[secret_scan.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.concat("base", "extra")).alias("spans"),
    )


@query
def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document under the counts of all others."""
    return backoff.score(documents(spark, sf_dir))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word, after one letter of one run in 97 was left out."""
    runs = spelling.runs(documents(spark, sf_dir))
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("word")).cast("binary"))
    changed = spelling.without_character(F.col("word"), F.pmod(F.col("h"), F.length("word")).cast("int"))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 97 == 0, changed).otherwise(F.col("word")).alias("word"))
    return spelling.group_variants(spelling.vocabulary(words))


def _with_repeated_tail(doc_id: F.Column, text: F.Column) -> F.Column:
    """Every tenth text with the words from a place on replaced by a repeated part of them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: F.Column) -> F.Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (3 + g % 8))
        repeated = bind(F.struct(a.alias("a"), p.alias("p")), lambda x: F.transform(words, lambda w, i: F.when(i < x.a, w).otherwise(F.get(words, (x.a + (i - x.a) % x.p).cast("int")))))
        return F.when(n > 0, F.array_join(repeated, " ")).otherwise(text)

    return F.when(text.isNotNull() & (h % 10 == 0), bind(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), tail)).otherwise(text)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of them with a repeated tail."""
    docs = documents(spark, sf_dir)
    edited = docs.select("doc_id", _with_repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.collapse_runs(edited, digest=True)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    rows = found.withColumns({"longest": longest, "listed": F.array_join(F.transform(listed, lambda x: F.concat(x, F.lit("\n"))), "")})
    return rows.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.l")).alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("-1000 * longest.l DIV longest.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that a whole text is toxic, learned from documents that are not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
