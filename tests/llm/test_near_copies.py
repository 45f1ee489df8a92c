"""How much work a large group of near copies makes, and the sketches that keep it small."""

from __future__ import annotations

import numpy as np

from thoughtlog.llm import simhash
from thoughtlog.llm.components import components
from thoughtlog.sources.scratch import Scratch


class Counting(Scratch):
    """Scratch that knows the rows of every table it stored."""

    def __init__(self, spark, folder):
        super().__init__(spark, folder)
        self.rows = []

    def store(self, df, name, compression=None):
        stored = super().store(df, name, compression)
        self.rows.append((name, stored.count()))
        return stored


def _edited(n: int, seed: int) -> list[tuple[int, str]]:
    """Copies of one text without the text itself, each with one to five words of its own."""
    r = np.random.default_rng(seed)
    base = [f"w{x}" for x in r.integers(0, 10**9, 150)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in r.choice(150, 1 + i % 5, replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    return rows


def _brute(rows, similarity=0.8):
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if len(x & y) >= similarity * len(x | y):
                top[max(find(a), find(b))] = min(find(a), find(b))
    return {rows[a][0]: rows[find(a)][0] for a in range(len(rows))}


def test_a_group_of_near_copies_makes_few_rows(spark, tmp_path):
    rows = _edited(240, 21)
    tables = Counting(spark, str(tmp_path))
    groups = simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), tables=tables)
    got, want = {x.doc_id: x.component_id for x in groups.collect()}, _brute(rows)
    wrong = [i for i in want if got[i] != want[i]]
    assert len(got) == len(rows) and len(wrong) <= 4 and len(set(got.values())) > 40, wrong
    # no row for every variant of a short fingerprint, and no pair that the sketches rule out
    assert max(n for _, n in tables.rows) <= simhash.KEYS * len(rows), tables.rows
    tried, alike = (sum(n for name, n in tables.rows if name == kind) for kind in ("pairs", "alike"))
    assert alike <= tried <= 2 * alike + len(rows), (tried, alike)


def test_texts_meet_as_balls_of_their_short_fingerprints_do(spark):
    shorts = spark.createDataFrame([(0, 0), (0, 3), (0, 7), (2**16 - 1, 2**16 - 4), (2**16 - 1, 0)], "short int, pivot_short int")
    assert [x.m for x in shorts.select(simhash._meet("short", "pivot_short").alias("m")).collect()] == [True, True, False, True, False]
    flat = np.concatenate([np.arange(40, dtype=np.uint64) * np.uint64(2**57 + 9)] * 2)
    keys, short = simhash.short_fingerprints(flat, np.array([40, 40]))
    assert keys.shape == short.shape == (2, simhash.KEYS)
    assert (keys[0] == keys[1]).all() and (short[0] == short[1]).all() and len(set(keys[0].tolist())) == simhash.KEYS
    assert (short >= 0).all() and (short < 2**simhash.KEY_BITS).all()


def test_sketches_never_rule_out_alike_sets(spark):
    """Random sets, some with exactly the wanted similarity; the empty set has an empty sketch."""
    r = np.random.default_rng(22)
    rows, exact = [], 0
    for _ in range(60):
        size, apart = int(r.integers(1, 400)), int(r.integers(0, 120))
        one = r.integers(0, 2**63, size).astype(np.uint64)
        other = np.concatenate([one[: max(0, size - apart)], r.integers(0, 2**63, int(r.integers(0, 60))).astype(np.uint64)])
        rows.append((one, other))
    for size in (9, 45, 90, 900):  # 8 of 10 items in common, and multiples
        items = r.integers(0, 2**63, size + size // 9).astype(np.uint64)
        rows.append((items[:size], items[size // 9 :]))
    flat = np.concatenate([x for pair in rows for x in pair] + [np.empty(0, np.uint64)])
    counts = np.array([len(x) for pair in rows for x in pair] + [0])
    sketches = simhash.odd_sketches(flat, counts)
    assert sketches.shape == (2 * len(rows) + 1, len(simhash._SKETCH)) and not sketches[-1].any()
    data = []
    for i, (one, other) in enumerate(rows):
        a, b = set(one.tolist()), set(other.tolist())
        likeness = len(a & b) / len(a | b)
        exact += likeness == 0.8
        data.append((likeness, len(a), *sketches[2 * i].tolist(), len(b), *sketches[2 * i + 1].tolist()))
    side = ["size", *simhash._SKETCH]
    names = ["likeness", *side, *[f"pivot_{n}" for n in side]]
    schema = ", ".join(f"{n} {'double' if n == 'likeness' else 'bigint'}" for n in names)
    got = spark.createDataFrame(data, schema).select("likeness", simhash._can_be_alike(0.8).alias("can")).collect()
    assert exact >= 4 and all(x.can for x in got if x.likeness >= 0.8)
    assert not any(x.can for x in got if x.likeness < 0.5)


def test_links_that_are_stars_take_no_round(spark, tmp_path):
    tables = Counting(spark, str(tmp_path))
    links = spark.createDataFrame([(i, 1) for i in range(2, 30)] + [(50, 40), (40, 60), (7, 7)], "a bigint, b bigint")
    got = {x.node: x.root for x in components(spark, links, tables).collect()}
    assert got == dict.fromkeys(range(1, 30), 1) | dict.fromkeys((40, 50, 60), 40)
    assert [name for name, _ in tables.rows] == ["links"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    assert {x.root for x in components(spark, chain, Scratch(spark, str(tmp_path))).collect()} == {0}
    assert components(spark, links.where("false"), Scratch(spark, str(tmp_path))).count() == 0


def test_no_pair_of_the_wanted_similarity_is_left_out(spark, tmp_path):
    """Pairs of different texts just at the similarity, and texts that are only like a few of a large
    group: all have the groups that a comparison of all pairs gives."""
    r = np.random.default_rng(31)
    rows = []
    for pair in range(400):  # 104 words, 100 shingles; edits in 2 places at least 5 words apart make 90 of 110
        words = [f"p{pair}w{i}" for i in range(104)]
        other = list(words)
        for at in (10 + int(r.integers(0, 30)), 60 + int(r.integers(0, 30))):
            other[at] = f"x{pair}y{at}"
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other[:-1] if pair % 2 else other))]
    assert {len(a & b) / len(a | b) >= 0.8 for a, b in zip(*[[set(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows[k::2]] for k in (0, 1)])} == {True}
    rows += [(10_000 + i, t) for i, t in _edited(400, 32)]
    want = _brute(rows[800:]) | {i: i - i % 2 for i, _ in rows[:800]}
    groups = simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), tables=Scratch(spark, str(tmp_path)))
    got = {x.doc_id: x.component_id for x in groups.collect()}
    assert got == want, sum(got[i] != want[i] for i in want)
