"""Secrets in texts: fixed patterns, and words that pass a battery of randomness tests.

Only DataFrame functions. A candidate is a long run of the characters that encoded keys use. Its
encoding is inferred from the characters it has; under that encoding's alphabet four statistics
are computed from its letters' numbers: the chi-squared distance from a uniform alphabet, the
same for digits against letters (where one case of letters is used; it tells words without a digit
from base 32 and 36), the number of runs above and below the middle, and the lag-one serial
correlation. Each gives a probability under "drawn at random"; ordinary words, paths and counters
score low. The least of the four, times four, is the candidate's p-value.

What is controlled is the share of ordinary words among the *reported* ones, over the whole corpus
and within each class of lengths, as long words are told from chance more surely. P-values of
words drawn at random are spread over all of 0 to 1, those of ordinary words crowd at 0; so the
candidates above ``RANDOM_ABOVE`` say how many random ones there are, and thus how many of those
above any limit are. Reported is what lies above the least limit at which the others, in excess
of them, are at most the wanted share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thoughtlog.functions.binding import bind
from thoughtlog.sources.scratch import Scratch

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, least length of what the pattern must give
ACCESS, ACCESS_LEAST = "AKIA[A-Z0-9]+", 20
HEX, HEX_LEAST = "[0-9a-f]", 24  # a run of characters: shorter ones need not be matched
ASSIGN_LEAST = 6
WORD = "[A-Za-z0-9+/_=-]"
WORD_LEAST = 24
FALSE_DISCOVERY = 0.05
LENGTH_CLASSES = (32, 48, 64, 96)
RANDOM_ABOVE = 0.1  # hardly any ordinary word has a p-value above this, 0.9 of the random ones do
_BINS = 400  # of log10 p, in steps of 0.05

#: Letters of each encoding in the order of their numbers.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper_hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}

_SPAN = "array<struct<start:int,place:int,kind:string,end:int,word:string>>"


def spans(text: Column, pattern: str, kind: str, place: int, fits: Column | None = None, least: int = 0, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, place, kind, end, word), code points, end
    exclusive; matches whose group is shorter than ``least`` are dropped after matching.

    Ends are running sums over matches and what lies between them, so no position is searched
    for; the work grows with the matches times their logarithm.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    inner = F.regexp_extract_all(text, F.lit(f"({pattern})"), group + 1) if group else whole
    steps = F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda b, m: F.length(b) + F.length(m))
    found = F.zip_with(whole, inner, lambda m, i: F.struct(m.alias("m"), F.length(i).alias("n")))

    def row(end: Column, x: Column) -> Column:
        start = end - F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("word"))
        return F.when(x["n"] >= least, span)

    rows = F.filter(F.zip_with(running_sums(steps), found, row), lambda x: x.isNotNull())
    return F.when(text.rlike(fits if fits is not None else pattern), rows).otherwise(F.array().cast(_SPAN))


def running_sums(numbers: Column) -> Column:
    """Sums of all numbers up to each place, by adding an array to itself shifted by 1, 2, 4 ..."""

    def double(sums: Column, k: Column) -> Column:
        far = F.pow(F.lit(2.0), k.cast("double")).cast("int")
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - far), F.lit(0)))

    def of(known: Column) -> Column:
        rounds = F.ceil(F.log2(F.greatest(F.size(known), F.lit(1)).cast("double"))).cast("int")
        return F.when(F.size(known) < 2, known).otherwise(F.aggregate(F.sequence(F.lit(0), rounds - 1), known, double))

    return bind(numbers, of)


def base_spans(text: Column) -> Column:
    return F.array_sort(
        F.concat(
            spans(text, ASSIGN, "assign", 1, least=ASSIGN_LEAST, group=1),
            spans(text, ACCESS, "access", 2, fits=f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4}}}", least=ACCESS_LEAST),
            spans(text, f"{HEX}{{{HEX_LEAST},}}", "hex", 3),
        )
    )


def _unsigned(word: Column) -> Column:
    return F.translate(word, "+/_=-", "")


def encoding(word: Column) -> Column:
    """Smallest alphabet that holds the word without its signs, which part the groups of a key
    or pad it; base64, where signs are letters, for every other word."""
    rest = _unsigned(word)
    digit, lower, upper = rest.rlike("[0-9]"), rest.rlike("[a-z]"), rest.rlike("[A-Z]")
    return (
        F.when(rest.rlike("^[0-9a-f]+$") & digit & lower, "hex")
        .when(rest.rlike("^[0-9A-F]+$") & digit & upper, "upper_hex")
        .when(rest.rlike("^[A-Z2-7]+$") & upper, "base32")
        .when(rest.rlike("^[0-9A-Z]+$") & upper, "upper36")
        .when(rest.rlike("^[0-9a-z]+$") & lower, "lower36")
        .otherwise("base64")
    )


def _by_encoding(kind: Column, value) -> Column:
    pick = F
    for name, letters in ALPHABETS.items():
        pick = pick.when(kind == name, value(letters))
    return pick


def _upper_normal(z: Column) -> Column:
    """Share of a normal variable above z: the logistic form, within 0.0002 of the exact one."""
    z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    return 1 / (1 + F.exp(0.07056 * z * z * z + 1.5976 * z))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_normal(F.abs(z)))


def battery(candidates: DataFrame, word: str = "word", kind: str = "encoding") -> DataFrame:
    """Add p_uniform, p_digits, p_runs, p_serial and p_value to rows with a word and its encoding."""
    signed = F.translate(F.translate(F.regexp_replace(word, "=+$", ""), "-", "+"), "_", "/")
    letters = F.when(F.col(kind) == "base64", signed).otherwise(_unsigned(F.col(word)))
    size = _by_encoding(F.col(kind), lambda a: F.lit(float(len(a))))
    alphabet = _by_encoding(F.col(kind), F.lit)
    rows = candidates.withColumn("_letters", letters).withColumn("_size", size).withColumn("_alphabet", alphabet)
    rows = rows.withColumn("_x", F.transform(F.split("_letters", ""), lambda c: F.position(c, F.col("_alphabet")) - 1))
    n = F.size("_x").cast("double")
    # Uniformity: squares of the letters' counts, each letter counting its own kind.
    squares = F.aggregate(
        F.array_distinct("_x"),
        F.lit(0.0),
        lambda total, x: total + F.pow(F.size(F.filter("_x", lambda y: y == x)).cast("double"), 2.0),
    )
    chi, df = squares * F.col("_size") / n - n, F.col("_size") - 1
    third = 2 / (9 * df)
    uniform = _two_sided((F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - third)) / F.sqrt(third))
    # Digits against letters, one degree of freedom; base64 mixes cases, which words seldom do.
    part = _by_encoding(F.col(kind), lambda a: F.lit(sum(c.isdigit() for c in a) / len(a)))
    digits_seen = F.length(F.regexp_replace("_letters", "[^0-9]", "")).cast("double")
    digits = F.when(F.col(kind) == "base64", 1.0).otherwise(_two_sided((digits_seen - n * part) / F.sqrt(n * part * (1 - part))))
    # Runs above and below the middle of the alphabet.
    sides = F.transform("_x", lambda x: (x >= F.col("_size") / 2).cast("int"))
    high = F.aggregate(sides, F.lit(0), lambda a, x: a + x).cast("double")
    changes = F.aggregate(
        F.zip_with(F.slice(sides, 2, F.size(sides)), sides, lambda a, b: F.coalesce((a != b).cast("int"), F.lit(0))), F.lit(0), lambda a, x: a + x
    ).cast("double")
    mean = 2 * high * (n - high) / n + 1
    spread = F.greatest((mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9))
    runs = F.when((high == 0) | (high == n), 0.0).otherwise(_two_sided((changes + 1 - mean) / F.sqrt(spread)))
    # Serial correlation of neighbours.
    center = F.aggregate("_x", F.lit(0.0), lambda a, x: a + x) / n
    moved = F.transform("_x", lambda x: x - center)
    variance = F.aggregate(moved, F.lit(0.0), lambda a, x: a + x * x)
    product = F.aggregate(F.zip_with(F.slice(moved, 2, F.size(moved)), moved, lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    serial = F.when(variance == 0, 0.0).otherwise(_two_sided((product / variance + 1 / n) * F.sqrt(n)))
    rows = rows.withColumns({"p_uniform": uniform, "p_digits": digits, "p_runs": runs, "p_serial": serial})
    least = F.least(F.lit(1.0), 4 * F.least("p_uniform", "p_digits", "p_runs", "p_serial"))
    return rows.withColumn("p_value", least).drop("_letters", "_size", "_alphabet", "_x")


def length_class(word: str = "word") -> Column:
    return reduce(lambda a, b: a + b, [(F.length(word) >= n).cast("int") for n in LENGTH_CLASSES])


def clear_of(words: Column, base: Column) -> Column:
    """The words, which follow one another, that overlap no base span.

    A word is clear if as many base spans end up to its start as begin before its end. Both numbers
    come from running sums over the sorted places, so the work is not words times spans.
    """

    def counted(words_at: str, base_at: str, base_first: bool) -> Column:
        """For each word, how many base places are before its own."""
        marks = F.transform(base, lambda b: F.struct(b[base_at].alias("at"), F.lit(0 if base_first else 1).alias("turn"), F.lit(1).alias("n")))
        asked = F.transform(words, lambda w: F.struct(w[words_at].alias("at"), F.lit(1 if base_first else 0).alias("turn"), F.lit(0).alias("n")))
        events = F.array_sort(F.concat(marks, asked))
        sums = running_sums(F.transform(events, lambda e: e["n"]))
        seen = F.zip_with(events, sums, lambda e, s: F.when(e["n"] == 0, s))
        return F.filter(seen, lambda s: s.isNotNull())

    begun, ended = counted("end", "start", False), counted("start", "end", True)
    clear = F.zip_with(begun, ended, lambda a, b: a == b)
    return F.filter(F.zip_with(words, clear, lambda w, c: F.when(c, w)), lambda w: w.isNotNull())


def random_limits(tested: DataFrame, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """(length_class, limit): of the candidates with a p-value above the limit, at most this share
    is not random, as far as the number of random ones can be told.

    P-values are counted in fixed steps of their logarithm, so the rule reads a few hundred
    counts for each class, whatever the size of the corpus. A class without a limit has nothing
    to report.
    """
    step = F.greatest(F.floor(F.log10(F.greatest("p_value", F.lit(1e-20))) * 20), F.lit(-_BINS)).alias("step")
    surely = F.count_if(F.col("p_value") > RANDOM_ABOVE).alias("surely")
    counts = tested.groupBy("length_class", step).agg(F.count(F.lit(1)).alias("n"), surely)
    each = Window.partitionBy("length_class")
    onward = each.orderBy("step").rangeBetween(0, Window.unboundedFollowing)
    # a candidate of a step has a p-value from this limit on
    limit = F.when(F.col("step") <= -_BINS, 0.0).otherwise(F.pow(F.lit(10.0), F.col("step") / 20))
    ranked = counts.select("length_class", limit.alias("limit"), F.sum("n").over(onward).alias("above"), F.sum("surely").over(each).alias("surely"))
    random = F.col("surely") / (1 - RANDOM_ABOVE) * (1 - F.least("limit", F.lit(RANDOM_ABOVE)))
    kept = ranked.where(F.col("above") - random <= rate * F.col("above"))
    return kept.groupBy("length_class").agg(F.min("limit").alias("limit"))


def scan(docs: DataFrame, rate: float = FALSE_DISCOVERY, tables: Scratch | None = None) -> DataFrame:
    """(doc_id, base, extra): spans of every document.

    ``base`` are the fixed patterns' spans by start, ``extra`` the words that the battery takes
    for random; both are arrays of (start, place, kind, end, word) in code points, end exclusive.
    Null and empty texts have none. Rows stand for themselves, repeated ones too; candidates of
    all rows are tested together. Other columns are not read.
    """
    tables = tables or Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    words = spans(text, f"{WORD}{{{WORD_LEAST},}}", "random", 4)
    marked = docs.select("doc_id", F.xxhash64("text").alias("text_key"), base_spans(text).alias("base"), words.alias("words"))
    marked = tables.store(marked, "spans")  # the texts are scanned once
    free = F.when(F.size("base") > 0, clear_of(F.col("words"), F.col("base"))).otherwise(F.col("words"))
    each = marked.where(F.size("words") > 0).select("doc_id", "text_key", F.explode(free).alias("span")).distinct()
    each = each.withColumn("word", F.col("span.word")).withColumn("encoding", encoding(F.col("word")))
    tested = tables.store(battery(each).withColumn("length_class", length_class()), "candidates")
    # a limit for each of a few classes of lengths
    random = tested.join(F.broadcast(random_limits(tested, rate)), "length_class").where("p_value >= limit")
    extra = random.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("span")).alias("extra"))
    extra = extra.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    joined = marked.join(extra, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.select("doc_id", "base", F.coalesce("extra", F.array().cast(_SPAN)).alias("extra"))


def listed(found: Column) -> Column:
    """``kind:start:end`` of spans, by start, then kind as listed, joined by commas."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.format_string("%s:%d:%d", s["kind"], s["start"], s["end"])), ",")


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")
