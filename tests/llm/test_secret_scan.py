"""The randomness battery and its limit against plain versions, and what is reported."""

from __future__ import annotations

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from thoughtlog.llm import secret_scan

ORDINARY = """ABSTRACT_SINGLETON_PROXY_FACTORY_BEAN /usr/local/share/applications/defaults
org_springframework_context_annotation Donaudampfschifffahrtsgesellschaft
internationalization_and_localization com/example/project/module/Service
getElementsByClassNameAndAttribute MAXIMUM_NUMBER_OF_CONNECTIONS_PER_HOST
pneumonoultramicroscopicsilicovolcanoconiosis 000000000000000000000000000001
abcdefghijklmnopqrstuvwxyz 123456789012345678901234567890 2024-01-01-2024-12-31-2025-01-01
this-is-a-very-long-slug-of-an-article-about-cats aaaaaaaaaaaaaaaaaaaaaaaaaaaa
====================================== ----------------------------------
shared/library/configuration/production thequickbrownfoxjumpsoverthelazydog""".split()


def keys(seed, n):
    r = random.Random(seed)
    alphabets = list(secret_scan.ALPHABETS.values())
    return ["".join(r.choice(alphabets[i % len(alphabets)]) for _ in range(r.choice([32, 40, 64]))) for i in range(n)]


def encoding(word):
    rest = re.sub(r"[+/_=-]", "", word)
    digit, lower, upper = (bool(re.search(p, rest)) for p in ("[0-9]", "[a-z]", "[A-Z]"))
    if re.fullmatch("[0-9a-f]+", rest) and digit and lower:
        return "hex"
    if re.fullmatch("[0-9A-F]+", rest) and digit and upper:
        return "upper_hex"
    if re.fullmatch("[A-Z2-7]+", rest) and upper:
        return "base32"
    if re.fullmatch("[0-9A-Z]+", rest) and upper:
        return "upper36"
    return "lower36" if re.fullmatch("[0-9a-z]+", rest) and lower else "base64"


def upper_normal(z):
    z = max(min(z, 30.0), -30.0)
    power = 0.07056 * z**3 + 1.5976 * z
    return 0.0 if power > 700 else 1 / (1 + math.exp(power))


def plain_battery(word):
    """The four probabilities by their textbook formulas."""
    kind = encoding(word)
    alphabet = secret_scan.ALPHABETS[kind]
    word = re.sub("=+$", "", word).replace("-", "+").replace("_", "/") if kind == "base64" else re.sub(r"[+/_=-]", "", word)
    x, k = [alphabet.find(c) for c in word], len(alphabet)
    n = len(x)
    chi = sum((x.count(i) - n / k) ** 2 / (n / k) for i in set(range(k)) | set(x)) if -1 not in x else sum(x.count(i) ** 2 for i in set(x)) * k / n - n
    third = 2 / (9 * (k - 1))
    uniform = min(1.0, 2 * upper_normal(abs(((max(chi, 0) / (k - 1)) ** (1 / 3) - (1 - third)) / math.sqrt(third))))
    sides = [i >= k / 2 for i in x]
    high, changes = sum(sides), sum(a != b for a, b in zip(sides, sides[1:]))
    mean = 2 * high * (n - high) / n + 1
    spread = max((mean - 1) * (mean - 2) / max(n - 1, 1), 1e-9)
    runs = 0.0 if high in (0, n) else min(1.0, 2 * upper_normal(abs((changes + 1 - mean) / math.sqrt(spread))))
    centre = sum(x) / n
    variance = sum((i - centre) ** 2 for i in x)
    product = sum((a - centre) * (b - centre) for a, b in zip(x, x[1:]))
    serial = 0.0 if variance == 0 else min(1.0, 2 * upper_normal(abs((product / variance + 1 / n) * math.sqrt(n))))
    share = sum(c.isdigit() for c in alphabet) / k
    z = (sum(c.isdigit() for c in word) - n * share) / math.sqrt(n * share * (1 - share))
    digits = 1.0 if kind == "base64" else min(1.0, 2 * upper_normal(abs(z)))
    return uniform, digits, runs, serial, min(1.0, 4 * min(uniform, digits, runs, serial))


def test_battery_equals_the_formulas(spark):
    words = [w for w in keys(3, 60) + ORDINARY if re.sub(r"[+/_=-]", "", w)]
    rows = spark.createDataFrame([(w,) for w in words], "word string").withColumn("encoding", secret_scan.encoding(F.col("word")))
    for r in secret_scan.battery(rows).collect():
        assert r.encoding == encoding(r.word)
        got = (r.p_uniform, r.p_digits, r.p_runs, r.p_serial, r.p_value)
        assert got == pytest.approx(plain_battery(r.word), abs=1e-9), r.word


def test_limit_equals_a_plain_search(spark):
    r = random.Random(8)
    rows = [(c, 10 ** -r.uniform(0, 8) if r.random() < 0.6 else r.random()) for c in (0, 0, 0, 1) for _ in range(150)]
    rows += [(2, 0.03), (3, 0.5), (3, 0.03)]
    got = {x.length_class: x.limit for x in secret_scan.random_limits(spark.createDataFrame(rows, "length_class int, p_value double")).collect()}
    for c in (0, 1, 2, 3):
        p = [x for k, x in rows if k == c]
        surely = sum(x > secret_scan.RANDOM_ABOVE for x in p) / 0.9
        limits = sorted(10 ** (math.floor(math.log10(x) * 20) / 20) for x in p)
        fits = [t for t in limits if sum(math.floor(math.log10(x) * 20) >= round(math.log10(t) * 20) for x in p) * 0.95 <= surely * (1 - min(t, 0.1)) + 1e-12]
        assert (min(fits) if fits else None) == pytest.approx(got.get(c))
    assert 2 not in got  # nothing there is surely random


@pytest.mark.parametrize("n_keys", [0, 3, 60])
def test_reported_words_are_keys(spark, n_keys):
    """Ordinary identifiers, paths and compounds among planted keys: precision and recall."""
    planted = [k for k in keys(5, n_keys) if encoding(k) != "hex"]  # lower hex is a base kind
    rows = list(enumerate([f"see {w} here" for w in planted + ORDINARY * 3]))
    found = secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    reported = {s.word for r in found for s in r.extra if s.word not in {b.word for b in r.base}}
    false = reported & set(ORDINARY)
    assert len(false) <= max(1, 0.1 * len(reported)), false
    if n_keys:
        assert len(reported & set(planted)) >= 0.85 * len(set(planted))
    else:
        assert len(reported) <= 1, reported


def test_a_text_of_many_matches(spark):
    """A megabyte of matches in one text."""
    words = keys(9, 20_000)
    text = " ".join(words) + " " + " ".join(f"password={w[:20]}" for w in words[:5000])
    started = time.monotonic()
    row = secret_scan.scan(spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")).where("doc_id = 1").first()
    assert time.monotonic() - started < 120
    assert sum(s.kind == "assign" for s in row.base) == 5000 and all(text[s.start : s.end] == s.word for s in [*row.base[:50], *row.base[-50:], *row.extra[-50:]])


def test_words_that_overlap_a_span_are_left_out(spark):
    r = random.Random(4)
    kind = "array<struct<start:int,end:int>>"
    rows = []
    for i in range(60):
        cuts = sorted(r.sample(range(200), 20))
        words = list(zip(cuts[::2], cuts[1::2]))
        base = [(a, a + r.randrange(1, 20)) for a in (r.randrange(200) for _ in range(i % 7))]
        rows.append((i, words, base))
    df = spark.createDataFrame(rows, f"i int, w {kind}, b {kind}")
    got = {x.i: [tuple(w) for w in x.c] for x in df.select("i", secret_scan.clear_of(F.col("w"), F.col("b")).alias("c")).collect()}
    assert got == {i: [w for w in words if not any(b[0] < w[1] and w[0] < b[1] for b in base)] for i, words, base in rows}


def test_running_sums(spark):
    r = random.Random(1)
    arrays = [[], [5], [1, 2], *[[r.randrange(100) for _ in range(n)] for n in (3, 4, 5, 8, 9, 100, 1000)]]
    got = [x.s for x in spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>").orderBy("i").select(secret_scan.running_sums(F.col("a")).alias("s")).collect()]
    assert got == [[sum(a[: i + 1]) for i in range(len(a))] for a in arrays]
