"""Periodic runs against a plain version of the rule."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thoughtlog.llm import periodic_runs, queries
from thoughtlog.llm.words import BETWEEN_SPACES, Words


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs_of(words, min_length=12):
    """(start, length, period) by comparing all places at all distances."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j - i + p >= min_length:
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def without(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    r = random.Random(3)
    out = [None, "", " \n", "a", "a " * 11, "a " * 12, "a " * 500, "a b " * 6, "a b " * 5 + "a", "  x " * 30]
    for _ in range(120):
        words = [r.choice("abcdefgh") for _ in range(r.randrange(0, 200))]
        for _ in range(r.randrange(0, 4)):
            p = r.choice([1, 2, 3, 5, 8, 13, 31, 32, 33, 64])
            part = [r.choice("abcdefghijklmnop") for _ in range(p)]
            at = r.randrange(0, len(words) + 1)
            n = r.randrange(p, 5 * p + 2)
            words[at:at] = (part * 6)[:n]
        out.append(" ".join(words))
    fibonacci = ["a", "b"]
    while len(fibonacci[-1]) < 700:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    out += [" ".join(fibonacci[-1]), " ".join(f"w{i % 700}" for i in range(2100)), " ".join(f"w{i}" for i in range(3000)), out[12], out[12]]
    return out


def test_runs_equal_all_comparisons(spark):
    rows = [(i % 100, t) for i, t in enumerate(texts())] + [(None, "x y z " * 9), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({n: F.lit(1) for n in ("octave", "tile", "words", "doc", "runs")}).repartition(5)
    want = sorted(((i, len(spaced(t)), runs_of(spaced(t)), without(spaced(t), runs_of(spaced(t)))) for i, t in rows), key=repr)
    got = periodic_runs.collapse_runs(docs).collect()
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == want
    assert sum(len(r.runs) for r in got) > 150


@pytest.mark.parametrize("least", [2, 5, 40])
def test_other_least_lengths(spark, least):
    rows = list(enumerate(texts()[:60]))
    got = periodic_runs.collapse_runs(spark.createDataFrame(rows, "doc_id bigint, text string"), least).collect()
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in got} == {i: runs_of(spaced(t), least) for i, t in rows}


def test_empty_table(spark):
    assert periodic_runs.collapse_runs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_long_text(spark):
    """Half a million words, one run across many tiles, all of one word in another text."""
    r = random.Random(1)
    part = [str(r.randrange(10**6)) for _ in range(70_000)]
    words = [str(r.randrange(10**6)) for _ in range(300_000)] + part * 3 + ["end"]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "again " * 100_000)], "doc_id bigint, text string")
    got = {x.doc_id: [tuple(y) for y in x.runs] for x in periodic_runs.collapse_runs(docs, digest=True).select("doc_id", "runs").collect()}
    assert got == {1: [(300_000, 210_000, 70_000)], 2: [(0, 100_000, 1)]}


def edited(doc_id, text):
    words = spaced(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_query_equals_plain_version(spark):
    sf_dir = "/root/testdata/sf0.001"
    want = {}
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        words = edited(row.doc_id, row.text)
        if len(words) > 3000:
            continue
        runs = runs_of(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (listed, without(words, runs))]
        want[row.doc_id] = (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], *digests)
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = {r.doc_id: tuple(r[n] for n in names) for r in queries.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert {i: got[i] for i in want} == want and sum(w[0] > 0 for w in want.values()) > 15


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_z_function(s):
    def common(i):
        k = 0
        while i + k < len(s) and s[k] == s[i + k]:
            k += 1
        return k

    assert periodic_runs.z_function(s) == [0 if i == 0 else common(i) for i in range(len(s))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=40), st.integers(1, 20), st.integers(2, 6))
def test_no_run_escapes_the_first_look(before, p, times):
    r = random.Random(p * times)
    part = [r.choice("abcde") for _ in range(p)]
    words = before + part * times + ["end"]
    found = {octave: set(tiles.tolist()) for octave, _, tiles in periodic_runs.suspects(Words([" ".join(words).encode()], BETWEEN_SPACES), 12)}
    for start, length, period in runs_of(words):
        octave = period.bit_length() - 1
        size = periodic_runs.tile_size(1 << octave)
        boundaries = [c for c in range(0, len(words), 1 << octave) if start <= c < start + length - period]
        assert boundaries and {c // size for c in boundaries} <= found[octave]
