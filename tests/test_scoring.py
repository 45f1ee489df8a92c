from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from thoughtlog.functions import scores as fs
from thoughtlog.functions.scores import score_array
from thoughtlog.operators import scoring as osc
from thoughtlog.operators.windows import token_windows
from thoughtlog.testing import fixture_pack as fx

VECTORS = [
    [1.0, 2.0, 3.0],
    [3.0, 3.0, 1.0],
    [-1.0, -1.0, -1.0],
    [0.1, float("nan"), 5.0],
    [800.0, 801.0, 799.5],
    [-2000.0, 0.0, 1.0],
]


def vectors(spark):
    return spark.createDataFrame([(v,) for v in VECTORS], "l array<double>").coalesce(1)


def test_argmax_first_wins(spark):
    got = [r[0] for r in vectors(spark).select(fs.argmax(F.col("l"))).collect()]
    assert got == [int(np.argmax(v)) for v in VECTORS]


def test_softmax_and_confidence(spark):
    l = F.col("l")
    rows = vectors(spark).select("l", fs.softmax(l), fs.confidence(l)).collect()
    for raw, probs, conf in rows:
        if not np.isnan(raw).any():
            e = np.exp(np.array(raw) - max(raw))
            assert np.allclose(probs, e / e.sum(), atol=1e-12)
            assert abs(conf - max(probs)) < 1e-12


def test_label_of(spark):
    df = spark.createDataFrame([(0,), (1,), (7,), (None,)], "i int")
    got = [r[0] for r in df.select(fs.label_of(F.col("i"), {0: "negative", 1: "Positive"})).collect()]
    assert got == ["NEGATIVE", "POSITIVE", "NEUTRAL", "NEUTRAL"]


def test_polarity_value(spark):
    df = spark.createDataFrame([("POSITIVE",), ("NEUTRAL",), ("NEGATIVE",), ("x",), (None,)], "p string")
    got = [r[0] for r in df.select(fs.polarity_value(F.col("p"))).collect()]
    assert got == [1, 0, -1, None, None]


def entries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [int(x) for x in rng.integers(0, 12, n)]) for i, n in enumerate([0, 1, 9, 400, 401, 1300, 5000])]
    return rows, spark.createDataFrame([*rows, (99, None)], "entry_id bigint, ids array<int>")


def expected_mean(ids, window, overlap):
    scores, start = [], 0
    while True:
        part = ids[start : start + window]
        scores.append([sum(1 for x in part if x % 3 == c) for c in range(3)])
        if start + window >= len(ids):
            return np.mean(scores, axis=0), len(scores)
        start += window - overlap


@pytest.mark.parametrize(("window", "overlap"), [(400, 50), (30, 10)])
@pytest.mark.parametrize("scorer", [fx.COLUMN_SCORER, fx.batch_scorer()], ids=["column", "batch"])
def test_classify_detailed(spark, scorer, window, overlap):
    rows, df = entries(spark)
    got = {r.entry_id: r for r in osc.classify_detailed(df, scorer, fx.LABELS, window, overlap).collect()}
    labels = {r.entry_id: r.polarity for r in osc.classify(df, scorer, fx.LABELS, window, overlap).collect()}
    for entry_id, ids in [*rows, (99, [])]:
        mean, n = expected_mean(ids, window, overlap)
        r = got[entry_id]
        assert np.allclose(r.logits, mean, atol=1e-9)
        assert r.n_windows == n
        assert r.polarity == labels[entry_id] == fx.LABELS[int(np.argmax(mean))]
        assert abs(sum(r.probabilities) - 1) < 1e-9
        assert abs(r.confidence - max(r.probabilities)) < 1e-9
    assert len(got) == len(rows) + 1


def test_in_place_mean_equals_grouped_mean(spark):
    _, df = entries(spark)
    grouped = osc.mean_logits(osc.score_windows(token_windows(df, 30, 10), fx.COLUMN_SCORER))
    in_place = osc.entry_logits(df, fx.COLUMN_SCORER, 30, 10)
    a = {r.entry_id: (r.logits, r.n_windows) for r in grouped.collect()}
    b = {r.entry_id: (r.logits, r.n_windows) for r in in_place.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert np.allclose(a[k][0], b[k][0]) and a[k][1] == b[k][1]


def test_model_input_is_framed(spark):
    df = spark.createDataFrame([(1, [5, 6])], "entry_id bigint, ids array<int>")
    scorer = osc.ColumnScorer(lambda ids: score_array([F.size(ids), ids[0], F.element_at(ids, -1)]), (0, 2))
    assert osc.entry_logits(df, scorer).first().logits == [4.0, 0.0, 2.0]
    assert osc.score_windows(token_windows(df), scorer).first().logits == [4.0, 0.0, 2.0]


def test_classes_without_a_label_are_neutral(spark):
    df = spark.createDataFrame([(1, [2, 5, 8]), (2, [3])], "entry_id bigint, ids array<int>")
    for scorer in (fx.COLUMN_SCORER, fx.batch_scorer()):
        rows = osc.classify(df, scorer, {0: "negative"}).collect()
        assert {r.entry_id: r.polarity for r in rows} == {1: "NEUTRAL", 2: "NEGATIVE"}


def test_batch_scorer_may_be_spread(spark):
    _, df = entries(spark)
    spread = osc.BatchScorer(fx.batch_scorer().score, partitions=3)
    windows = token_windows(df, 30, 10)
    one = sorted(map(tuple, osc.score_windows(windows, spread).select("entry_id", "window_no").collect()))
    two = sorted(map(tuple, windows.select("entry_id", "window_no").collect()))
    assert one == two


def test_winner_beyond_the_labels_is_neutral(spark):
    df = spark.createDataFrame([(1, [1, 1])], "entry_id bigint, ids array<int>")
    fixed = osc.ColumnScorer(lambda ids: score_array([F.lit(x) for x in (1, 2, 3, 9)]))

    def score(frames):
        for frame in frames:
            yield frame[["entry_id", "window_no"]].assign(logits=[[1.0, 2.0, 3.0, 9.0]] * len(frame))

    for scorer in (fixed, osc.BatchScorer(score)):
        assert osc.classify(df, scorer, {0: "a", 1: "b", 2: "c"}).first().polarity == "NEUTRAL"
        row = osc.classify_detailed(df, scorer, {0: "a", 1: "b", 2: "c"}).first()
        assert row.polarity == "NEUTRAL" and row.logits == [1.0, 2.0, 3.0, 9.0]
        assert len(row.probabilities) == 4 and row.confidence > 0.99


@pytest.mark.parametrize("fault", ["lost window", "lost entry", "short", "null score", "null vector"])
def test_faulty_scores_raise(spark, fault):
    df = spark.createDataFrame([(1, list(range(900))), (2, [5])], "entry_id bigint, ids array<int>")

    def score(frames):
        for frame in frames:
            out = frame[["entry_id", "window_no"]].assign(logits=[[1.0, 2.0] for _ in range(len(frame))])
            first = (out.entry_id == 1) & (out.window_no == out.window_no.min())
            if fault == "lost window":
                out = out[~first]
            elif fault == "lost entry":
                out = out[out.entry_id == 2]
            else:
                bad = {"short": [1.0], "null score": [1.0, None], "null vector": None}[fault]
                out["logits"] = [bad if f else x for f, x in zip(first, out.logits)]
            yield out

    with pytest.raises(Exception, match="score vectors of an entry"):
        osc.classify(df, osc.BatchScorer(score), {0: "a", 1: "b"}).collect()


def test_uneven_column_scores_raise(spark):
    df = spark.createDataFrame([(1, list(range(900)))], "entry_id bigint, ids array<int>")
    uneven = osc.ColumnScorer(lambda ids: F.when(ids[0] > 0, score_array([F.lit(1)])).otherwise(score_array([F.lit(1), F.lit(2)])))
    with pytest.raises(Exception, match="score vectors of an entry"):
        osc.classify(df, uneven, {0: "a", 1: "b"}).collect()


@pytest.mark.parametrize("fault", ["doubled", "unknown", "late"])
def test_windows_that_were_not_asked_for_raise(spark, fault):
    df = spark.createDataFrame([(1, list(range(900))), (2, [5])], "entry_id bigint, ids array<int>")

    def score(frames):
        import pandas as pd

        held = []
        for frame in frames:
            out = frame[["entry_id", "window_no"]].assign(logits=[[1.0, 2.0] for _ in range(len(frame))])
            if fault == "doubled":
                out = pd.concat([out, out])
            elif fault == "unknown":
                out["window_no"] += 1
            held.append(out)
        yield from held

    run = osc.classify(df, osc.BatchScorer(score), {0: "a", 1: "b"})
    if fault == "late":  # a scorer may hold windows back until the end
        assert {r.entry_id: r.polarity for r in run.collect()} == {1: "B", 2: "B"}
    else:
        with pytest.raises(Exception, match="score vectors of an entry"):
            run.collect()


def test_longer_inputs_are_a_matter_of_the_scorer(spark):
    df = spark.createDataFrame([(1, list(range(3000)))], "entry_id bigint, ids array<int>")
    long = osc.ColumnScorer(fx.COLUMN_SCORER.score, input_limit=4096)
    assert osc.classify_detailed(df, long, fx.LABELS, 2048, 48).first().n_windows == 2
    batch = osc.BatchScorer(fx.batch_scorer().score, input_limit=4096)
    assert osc.classify_detailed(df, batch, fx.LABELS, 4094, 0).first().n_windows == 1
    for scorer in (fx.COLUMN_SCORER, fx.batch_scorer()):
        with pytest.raises(ValueError, match="at most 512"):
            osc.classify(df, scorer, fx.LABELS, 2048, 48)
