"""Memory of workers."""

from __future__ import annotations

import tracemalloc

import numpy as np

from thoughtlog.llm import token_ids
from thoughtlog.llm.language_id import ContextModel
from thoughtlog.llm.queries import vocabulary


def test_costs_of_a_long_text_are_held_in_parts():
    rows = [(k, 0, 97 + k, 5) for k in range(2)] + [(0, 0, 0, 1)]
    model = ContextModel(["x", "y"], 0, rows)
    texts = [b"ab" * 500_000, b"", b"b" * 70_001]
    tracemalloc.start()
    bits = model.bits(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6
    each = model.bits([b"a", b"b"])
    assert np.allclose(bits, [500_000 * (each[0] + each[1]), [0, 0], 70_001 * each[1]])


def test_words_are_made_once_and_forgotten_in_generations(monkeypatch):
    monkeypatch.setattr(token_ids, "REMEMBERED", 8)
    ids = token_ids.WordIds(vocabulary())
    made = []
    word = ids.known.make
    ids.known.make = lambda w: made.append(w) or word(w)
    assert ids.of(b"Alpha beta Alpha beta") == ids.of(b"alpha beta") + ids.of(b"ALPHA beta")
    assert sorted(made) == [b"ALPHA", b"Alpha", b"alpha", b"beta"]
    for k in range(50):
        ids.of(b"w%d x%d" % (k, k))
        assert len(ids.known) + len(ids.units) <= 8 + 4 and not getattr(ids.known.older, "older", {})
