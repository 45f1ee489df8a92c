from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from thoughtlog.operators.keywords import frequent_terms, term_frequency, top_terms


def corpus(spark, seed, n=1500):
    """One persona has most entries; every entry has terms that nobody else uses."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        persona = r.choice(["hot", "hot", "hot", "hot", "a", "b", None])
        common = [f"c{min(int(r.expovariate(0.15)), 60)}" for _ in range(r.randrange(8))]
        rows.append((i, persona, " ".join(common + [f"rare{i}x{j}" for j in range(6)]) if i % 20 else None))
    return rows, spark.createDataFrame(rows, "entry_id bigint, persona string, keywords string").repartition(6)


@pytest.mark.parametrize(("k", "part", "buckets"), [(5, 4, 1 << 12), (20, 16, 64), (70, 2, 1 << 18), (3, 1, 1)])
def test_same_rows_as_all_counts(spark, k, part, buckets):
    rows, df = corpus(spark, k)
    counts = defaultdict(Counter)
    for _, persona, keywords in rows:
        counts[persona].update((keywords or "").split())
    want = {(p, t, n, rank) for p, c in counts.items() for rank, (t, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}
    got = frequent_terms(df, k, part, buckets)
    assert {(r.persona, r.term, r.n, r["rank"]) for r in got.collect()} == want
    assert got.count() == len(want) == top_terms(term_frequency(df), k).count()


def test_rare_pairs_are_left_out_before_the_shuffle(spark):
    _, df = corpus(spark, 1, 6000)
    few = frequent_terms(df.where("persona = 'hot'"), 10, 8)
    plan = few._jdf.queryExecution().executedPlan()
    plan.execute().count()
    text = plan.toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text
    known = few.groupBy().agg(F.sum("n")).first()[0]
    assert known > 0
    distinct = term_frequency(df.where("persona = 'hot'")).count()
    survivors = frequent_terms(df.where("persona = 'hot'"), 10**6, 8).count()  # no bound: all pairs
    assert survivors == distinct


def test_empty(spark):
    df = spark.createDataFrame([], "entry_id bigint, persona string, keywords string")
    assert frequent_terms(df).count() == 0
