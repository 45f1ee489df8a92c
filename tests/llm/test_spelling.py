"""Spelling variants against a plain version of the rule."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thoughtlog.llm import queries, spelling


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def counted(rows):
    """n by word, one letter of one run in 97 left out."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(n):
    words = sorted(n)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_words(seed, size):
    r = random.Random(seed)
    syllables = ["an", "ba", "th", "er", "né", "o", "x", "ing"]
    words = {"".join(r.choice(syllables) for _ in range(r.randrange(2, 6))) for _ in range(size)}
    words |= {w[:i] + r.choice("abéx") + w[i + 1 :] for w in list(words)[: size // 2] for i in (0, len(w) // 2, len(w) - 1)}
    words |= {"a" * k for k in range(5, 12)} | {"ab" * k for k in range(3, 6)} | {"q" * 300, "q" * 299, "q" * 150 + "z" + "q" * 149}
    return {w: r.choice([3, 3, 4, 6, 7, 12, 50, 200]) for w in words if len(w) >= 5}


@pytest.mark.parametrize("least_rare", [1, 5, 10**6])
def test_variants_equal_all_comparisons(spark, monkeypatch, least_rare):
    monkeypatch.setattr(spelling.frequent_grams, "__defaults__", (spelling.MAX_GRAMS, least_rare))
    n = random_words(least_rare, 350)
    vocab = spark.createDataFrame(list(n.items()), "word string, n bigint").repartition(3)
    assert rows_of(spelling.group_variants(vocab)) == expected(n)


def test_query_equals_plain_version(spark, tmp_path):
    r = random.Random(5)
    words = ["Stone", "stones", "stone", "Étage", "étages", "letter", "better", "bitter", "a", "×÷×÷×", "naïve", "stonés", "latter"]
    texts = [" ".join(r.choice(words) + r.choice(["", ",", "1", "-"]) for _ in range(r.randrange(0, 200))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (7, texts[7]), (102, "stoné" * 20_000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(queries.QUERIES["op13_spelling_variants"](spark, str(tmp_path)))
    assert got == expected(counted(rows)) and any(x[1] for x in got)


def test_real_words_equal_all_deletions(spark):
    """On the smallest table, with the near words found through all one-letter deletions."""
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    n = counted(rows)
    by_key = {}
    for w in n:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_key.setdefault(key, []).append(w)
    near = Counter()
    seen = set()
    for group in by_key.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if (a, b) not in seen and one_edit(a, b):
                    seen |= {(a, b), (b, a)}
                    near[a] += 1
                    near[b] += 1
    got = queries.QUERIES["op13_spelling_variants"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.word, r.n, r.n_near) for r in got} == {(w, k, near[w]) for w, k in n.items()}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "word string, n bigint")
    assert spelling.group_variants(empty).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    assert spelling.group_variants(spelling.vocabulary(spelling.runs(none))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=5, max_size=9), st.integers(0, 2), st.integers(0, 8), st.sampled_from("abc"), st.sets(st.text("^ab$", min_size=2, max_size=4)))
def test_near_words_share_one_list_where_they_differ(word, kind, at, letter, frequent):
    """Whatever grams are frequent: exactly one list has both words and keeps the pair."""
    at = at % len(word)
    other = [word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]][kind]
    if other == word:
        return
    grams = frozenset(frequent)
    lists = [{(gap, low, high, word_, 3): key for gap, low, high, key in spelling.edit_keys(f"^{word_}$", grams)} for word_ in (word, other)]
    hits = [(x, y) for x, k in lists[0].items() for y, q in lists[1].items() if k == q and spelling._linked(x, y)]
    assert len(hits) == 1
