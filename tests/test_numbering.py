from __future__ import annotations

import random

import pytest

from thoughtlog.operators.numbering import assign_ids, day_number, running_number


@pytest.mark.parametrize("ranges", [1, 7, 300])
def test_running_number_with_one_large_group(spark, ranges):
    rng = random.Random(3)
    ids = rng.sample(range(-500, 5000), 900)
    rows = [(i, "big" if k % 3 else rng.choice("abc")) for k, i in enumerate(ids)]
    rows += [(6001, None), (6002, None), (2**60, "big"), (None, "big"), (None, "a")]
    df = spark.createDataFrame(rows, "entry_id bigint, persona string").repartition(5)
    got = running_number(df, "day_no", "entry_id", ["persona"], ranges).collect()
    want, seen = {}, {}
    for i, persona in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        seen[persona] = seen.get(persona, 0) + 1
        want[i] = None if persona is None else seen[persona]
    want[None] = None
    assert {r.entry_id: r.day_no for r in got} == want and len(got) == len(rows)


def test_day_number_follows_ids(spark):
    df = spark.createDataFrame([(5, "a"), (2, "a"), (3, "b")], "entry_id bigint, persona string")
    assert {r.entry_id: r.day_no for r in day_number(df).collect()} == {5: 2, 2: 1, 3: 1}


def test_failed_rows_take_no_id(spark):
    rows = [(g, None if g % 7 == 0 else f"t{g}") for g in range(40)]
    df = spark.createDataFrame(rows, "grid_no bigint, text string").repartition(3)
    got = {r.grid_no: r.entry_id for r in assign_ids(df).collect()}
    kept = [g for g, text in rows if text is not None]
    assert got == {g: n for n, g in enumerate(kept, 1)}


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_any_key_that_can_be_sorted(spark, ranges):
    """Strings, timestamps and several keys at once; equal keys get different numbers in a row."""
    rng = random.Random(ranges)
    rows = [(f"k{rng.randrange(40)}" if i % 9 else None, f"2024-01-{rng.randrange(1, 29):02d} 10:00:00", i, rng.choice(["p", "q", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "name string, at string, i bigint, g string").selectExpr("name", "to_timestamp(at) AS at", "i", "g").repartition(4)
    for order in ("name", "at", ["name", "at"], ["at", "i"]):
        for by in ([], ["g"], ["g", "name"]):
            got = running_number(df, "no", order, by, ranges).collect()
            assert len(got) == len(rows)
            groups = {}
            for r in got:
                keys = [order] if isinstance(order, str) else order
                if all(r[k] is not None for k in [*keys, *by]):
                    groups.setdefault(tuple(r[k] for k in by), []).append((r.no, *(r[k] for k in keys)))
                else:
                    assert r.no is None
            for numbered in groups.values():
                numbered.sort()
                assert [x[0] for x in numbered] == list(range(1, len(numbered) + 1))
                assert [x[1:] for x in numbered] == sorted(x[1:] for x in numbered)


def test_repeated_rows_and_maps(spark):
    df = spark.createDataFrame([(1, {"a": 1})] * 5 + [(None, {}), (0, None)], "entry_id bigint, m map<string,int>")
    got = running_number(df, "no", "entry_id").collect()
    assert sorted((r.entry_id, r.no) for r in got if r.no) == [(0, 1), *[(1, k) for k in range(2, 7)]]
    assert running_number(df.where("false"), "no", "entry_id").count() == 0


def test_numbers_are_the_same_in_every_run(spark):
    df = spark.range(1000).selectExpr("id % 7 AS k", "id").repartition(6)
    runs = [{r.id: r.no for r in running_number(df.repartition(n), "no", "k", ranges=5).collect()} for n in (2, 9)]
    assert runs[0] == runs[1]
