from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from thoughtlog.plans.growing_views import add_batch, read_views
from thoughtlog.plans.persona_views import long_rows, persona_views
from thoughtlog.schemas import NO_EMOTION, PROCESSED
from thoughtlog.sources.scratch import fresh_path


def entries(spark, ids, seed=1):
    r = random.Random(seed)
    rows = []
    for i in ids:
        emotions = ", ".join(sorted({r.choice(["Raiva", "Angústia"]) for _ in range(2)})) if i % 3 else NO_EMOTION
        polarity = r.choice(["POSITIVE", "NEGATIVE", "NEUTRAL", None])
        keywords = " ".join(r.choice("abcdefgh") * 3 for _ in range(r.randrange(6)))
        rows.append((i, r.choice(["p", "q", None]), "t", "a", "s", "t", emotions, "r", "g", polarity, keywords))
    return spark.createDataFrame(rows, PROCESSED)


def numbers(views):
    return sorted(map(tuple, long_rows(views).collect()), key=repr)


def test_batches_add_up(spark):
    path = fresh_path(spark, "grown")
    whole = entries(spark, range(1, 91))
    for batch, low, high in (("1", 1, 40), ("2", 41, 41), ("3", 42, 90)):
        add_batch(whole.where(F.col("entry_id").between(low, high)), path, batch)
    want = persona_views(whole, ordered=False)
    got = read_views(spark, path, ordered=False)
    assert numbers(got) == numbers(want)
    assert sorted(map(tuple, got["summary"].collect()), key=repr) == sorted(map(tuple, want["summary"].collect()), key=repr)
    assert got["personas"].collect() == want["personas"].collect()


def test_a_batch_may_be_written_again_and_counts_once(spark):
    path = fresh_path(spark, "grown")
    whole = entries(spark, range(1, 31))
    first, last = whole.where("entry_id <= 20"), whole.where("entry_id > 20")
    for batch, rows in (("1", first), ("2", last), ("2", last)):
        add_batch(rows, path, batch)
    assert numbers(read_views(spark, path, ordered=False)) == numbers(persona_views(whole, ordered=False))


def test_an_unfinished_batch_is_not_seen(spark):
    path = fresh_path(spark, "grown")
    whole = entries(spark, range(1, 31))
    add_batch(whole, path, "1")
    spark.createDataFrame([("p", "x", 5)], "persona string, term string, n bigint").write.parquet(f"{path}/terms/batch=2")
    assert numbers(read_views(spark, path, ordered=False)) == numbers(persona_views(whole, ordered=False))


def test_entries_that_come_too_late_raise(spark):
    path = fresh_path(spark, "grown")
    add_batch(entries(spark, range(50, 80)), path, "1")
    with pytest.raises(Exception, match="does not follow"):
        add_batch(entries(spark, range(60, 70), 2), path, "2")


def test_empty_batches(spark):
    path = fresh_path(spark, "grown")
    assert numbers(read_views(spark, path, ordered=False)) == []
    add_batch(entries(spark, []), path, "1")
    assert numbers(read_views(spark, path, ordered=False)) == []
