"""Toxicity: voters, label model and classifier, and held-out accuracy."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from thoughtlog.llm import queries, toxicity
from thoughtlog.llm.toxicity import LabelModel, Voters


def sums_of(x, q):
    wide = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    return np.stack([(wide * w[:, None]).T @ wide for w in (1 - q, q)])


def test_votes_of_a_text():
    voters = Voters(("flug", "zorn"), ("achlich",))
    words = voters.n_votes
    base = len(toxicity.FIXED) + len(toxicity.PATTERNS)
    assert voters.active("") == []
    assert voters.active("You are an idiot") == [0, 5]
    assert 4 in voters.active("such an id*iot here") and 4 in voters.active("such an 1diot 1d1ot idi0t here")
    assert 6 in voters.active("ALL OF THIS IS LOUD") and 7 in voters.active("a!! b!!")
    assert voters.active("Zorn ist hier") == [base + 1, words + 1]
    assert voters.active("achlicher") == []  # once is not often enough
    assert voters.active("achlicher achlichen") == [base + toxicity.LISTS, words + 2]
    assert voters.active("achlicher achlichen " + "wort " * 1000) == []


def test_label_model_against_sums_over_all_votes():
    """The posterior is that of the tree, and the chances of all vote patterns add up to one."""
    r = np.random.default_rng(3)
    x = (r.random((400, 5)) < 0.4).astype(int)
    x[:, 3] = x[:, 1] ^ (r.random(400) < 0.1)
    q = np.clip(0.8 * x[:, 0] + 0.1, 0, 1)
    model = LabelModel(sums_of(x, q))
    assert model.parent[0] == -1 and (model.parent[3] == 1 or model.parent[1] == 3)
    every = np.array(list(itertools.product([0, 1], repeat=5)))
    chance = np.zeros((2, len(every)))
    for k, v in enumerate(every):
        for y in (0, 1):
            p = [1 - model.prior, model.prior][y]
            for j, parent in enumerate(model.parent):
                p *= math.exp(model.chance[y, j, v[parent] if parent >= 0 else 0, v[j]])
            chance[y, k] = p
    assert abs(chance.sum() - 1) < 1e-9
    assert np.allclose(model.posterior(every), chance[1] / chance.sum(axis=0))


def test_label_model_finds_accuracies_and_correlations(spark):
    """Votes drawn from a known model without labels; two voters copy each other."""
    r = np.random.default_rng(5)
    n = 20_000
    y = r.random(n) < 0.2
    rates = np.array([[0.02, 0.7], [0.05, 0.6], [0.01, 0.5], [0.1, 0.8], [0.03, 0.4]])
    x = np.stack([r.random(n) < np.where(y, b, a) for a, b in rates], axis=1).astype(int)
    copy = np.where(r.random(n) < 0.9, x[:, 3], 0)[:, None]
    x = np.concatenate([x, copy], axis=1)
    counts = Counter((int(v @ (1 << np.arange(6))), None) for v in x)
    patterns = spark.createDataFrame([(v, g, k) for (v, g), k in counts.items()], "votes bigint, gold int, n bigint")
    model = toxicity.learn_labels(patterns, 6)
    assert abs(model.prior - 0.2) < 0.03
    assert np.abs(model.accuracy[:, :5] - rates.T).max() < 0.08
    assert model.parent[5] == 3 or model.parent[3] == 5
    assert ((model.posterior(x) > 0.5) == y).mean() > 0.95


def test_induced_terms_and_ratio(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = [r.choice("abcdefgh") + r.choice("klmnop") + r.choice("xyz") for _ in range(80)]
        if toxic:
            words[r.randrange(80)] = "zorniger"
            words[3], words[9] = "schlimm" + r.choice("abc"), "schlimm" + r.choice("def")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, gold int")
    voters = toxicity.induce(docs, known)
    assert "zorniger" in voters.words and "schlim" in voters.beginnings and len(voters.words) < 20
    one = spark.range(1).select(toxicity.log_likelihood_ratio(F.lit(30), F.lit(2), 80, 320).alias("g")).first().g
    cells = [(30, 32 * 80 / 400), (2, 32 * 320 / 400), (50, 368 * 80 / 400), (318, 368 * 320 / 400)]
    assert abs(one - 2 * sum(n * math.log(n / e) for n, e in cells)) < 1e-9


def test_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = queries.QUERIES["op11_toxicity"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    hits = Counter((r.toxic, r.predicted) for r in rows)
    precision = hits[1, 1] / (hits[1, 1] + hits[0, 1])
    recall = hits[1, 1] / (hits[1, 1] + hits[1, 0])
    # some texts were overwritten with junk after they were labelled
    assert precision > 0.97 and recall > 0.9, hits
    assert got.count() == 10_000 and got.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()


@pytest.mark.parametrize("given", ["none", "clean", "odd"])
def test_odd_rows_and_labels(spark, odd, given):
    labels = {"none": [], "clean": [(4, 0), (11, 0)], "odd": [(4, 1), (4, 0), (None, 1), (11, None), (18, 0), (10**9, 1)]}[given]
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    docs = odd.withColumns({n: F.lit(1) for n in ("votes", "active", "gold", "label", "features")})
    got = toxicity.score(docs, table, F.lit(True))
    assert got.columns == ["doc_id", "label", "features", "score"]
    assert got.count() == odd.count() and got.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    blank = toxicity.score(docs.where("false"), table, F.lit(True))
    assert blank.count() == 0


def test_labels_that_may_not_be_learned_change_nothing(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learnable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    turned = labels.withColumn("toxic", F.when(learnable, F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, t, learnable).collect()} for t in (labels, turned))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-6
