"""Token ids of whole texts by a public tokenizer, with the ids of words remembered.

The vocabulary's rules never join characters across ASCII white space, so a text's ids are those
of its words one after another. Words seen before are looked up. A new word that is only letters,
or letters and then signs, is one or two units of the vocabulary's own rules, which go straight to
the library's merge model; any other word, and any text with a special token, goes through the
library whole. The memory of a worker is bounded: it has two generations, and when the young one is
full, the old one goes and the young one takes its place; words that are met again move on.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

REMEMBERED = 500_000  # words and units of each of two generations
# Letters of ASCII and Latin-1: each is one composed character with one lower-case form.
_LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
# ASCII signs but the apostrophe, which the rules join to some letters.
_PLAIN = re.compile(rb"(" + _LETTERS + rb")([!-&(-/:-@\[-`{-~]*)")


def _visible() -> dict[int, int]:
    """The character that stands for each byte inside a byte-level vocabulary: printable Latin-1
    for itself, the others in order from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


class _Memory(dict):
    """Answers that were asked for before, with those of the generation before as long as they wait."""

    def __init__(self, make, older: dict):
        self.make, self.older = make, older

    def __missing__(self, key):
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        self[key] = ids
        return ids

    def young(self) -> "_Memory":
        """A new generation; the one before this one goes."""
        self.older = {}
        return _Memory(self.make, self)


class WordIds:
    """Ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self._visible = _visible()
        self._merge = self.tokenizer.model.tokenize
        self._packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known, self.units = _Memory(self._word, {}), _Memory(self._unit, {})

    def _encode(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        shown = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self._visible)
        packed = self._packed
        return b"".join([packed[t.id] for t in self._merge(shown)])

    def _word(self, word: bytes) -> bytes:
        parts = _PLAIN.fullmatch(word)
        if parts is None:
            return self._encode(word)
        letters, signs = parts.groups()
        ids = self.units[letters.decode().lower()]
        return ids + self.units[signs.decode()] if signs else ids

    def of(self, text: bytes) -> bytes:
        """Ids of a whole text."""
        if b"<|" in text:  # special tokens are found before anything else is split
            return self._encode(text)
        if len(self.known) + len(self.units) > REMEMBERED:
            self.known, self.units = self.known.young(), self.units.young()
        return b"".join(map(self.known.__getitem__, text.split()))


_OPEN: dict[str, WordIds] = {}


def opened(path: str) -> WordIds:
    """One encoder for each worker and vocabulary."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]
