"""Periodic runs of words: stretches that repeat a shorter sequence of words.

A place *matches* at period p if its word is that p places further on. A run of period p is a
longest stretch of matching places, at least p of them, together with the p words after it.

1. Periods fall into octaves from P = 2**k to 2P - 1. For every octave a document is exploded into
   overlapping tiles: some boundaries, one every P words, with 2P words before the first and 4P
   after the last. P places in a row hold a boundary, so every run crosses one of its octave.
   Tiles in which no block of half the least stretch comes again at a distance of the octave
   cannot hold a run and are not made; that look uses hashes, all else compares words.
2. A tile is solved by itself. At a boundary two Z-functions, of the words after it and of the
   words before it read backwards, give for every period how far the matches go on either side,
   2P places at most, which reaches past the neighbouring boundaries.
3. The matching intervals are shuffled by document and period, where those that touch or overlap
   are stitched together. A stretch found at several periods is kept at the smallest.

Documents are known by a 128-bit hash of their text, so copies share their tiles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thoughtlog.llm import chunks
from thoughtlog.llm.words import BETWEEN_SPACES, Words, mix, sequence_hashes
from thoughtlog.sources.scratch import Scratch

MIN_LENGTH = 12
_LEAST_TILE = 64  # words between the first boundaries of two tiles, at least
_BLOCK = 1 << 20

_PIECES = "doc_id bigint, doc binary, n_words bigint, text string, octave int, tile bigint, first bigint, words binary"
_PIECES_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("doc", pa.binary()), ("n_words", pa.int64()), ("text", pa.string()), ("octave", pa.int32()), ("tile", pa.int64()), ("first", pa.int64()), ("words", pa.binary())]
)
_MATCHES = "doc binary, period bigint, low bigint, high bigint"
_MATCHES_ARROW = pa.schema([("doc", pa.binary()), ("period", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def least_matches(period: int, min_length: int) -> int:
    """Fewest matching places of a run with a period of the octave that begins with this one."""
    return min(max(p, min_length - p) for p in range(period, min(2 * period, max(period, min_length) + 1)))


def tile_size(period: int) -> int:
    return max(_LEAST_TILE, 4 * period)


def suspects(words: Words, min_length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(octave, texts, tiles) that may hold a run, over a list of texts.

    A run of the octave holds a whole block, on a grid of the block's length, that comes again at
    one of the octave's distances. Blocks grow from one step to the next, and a place whose block
    is alone in its text is not looked at again.
    """
    counts = words.counts()
    owner = np.repeat(np.arange(len(counts)), counts)
    salt = mix(owner.astype(np.uint64) + np.uint64(1))
    alive = np.arange(len(owner))
    longest = int(counts.max(initial=0))
    octaves = [(-(-least_matches(1 << k, min_length) // 2), k) for k in range(longest.bit_length()) if 2 << k <= longest]
    for block, octave in sorted(octaves):
        period = 1 << octave
        alive = alive[alive + block <= words.first[owner[alive] + 1]]
        if not len(alive):
            return
        hashes = sequence_hashes(words.hashes, alive, alive + block) ^ salt[alive]
        order = np.argsort(hashes, kind="stable")
        at, hashes = alive[order], hashes[order]
        change = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        group = np.cumsum(change) - 1
        repeated = np.bincount(group)[group] > 1
        at, group = at[repeated], group[repeated]
        alive = np.sort(at)
        place = at - words.first[owner[at]]
        wide = len(owner) + 2 * period + 1
        keys = group * wide + at
        grid = np.flatnonzero(place % block == 0)
        wanted = keys[grid] + period
        found = np.searchsorted(keys, wanted)
        inside = found < len(keys)
        inside[inside] = keys[found[inside]] < wanted[inside] + period
        hit = grid[inside]
        if not len(hit):
            continue
        text, place = owner[at[hit]], place[hit]
        reach = max(period, least_matches(period, min_length))
        size = tile_size(period)
        tiles = [np.clip(place + shift, 0, counts[text] - 1) // size for shift in (-reach, 0, reach)]
        pairs = np.unique(np.stack([np.tile(text, 3), np.concatenate(tiles)], axis=1), axis=0)
        yield octave, pairs[:, 0], pairs[:, 1]


def _explode(min_length: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks.batched(batches, "text", _BLOCK):
            texts = chunks.encoded(batch.column("text"))
            words = Words(texts, BETWEEN_SPACES)
            counts = words.counts().tolist()
            found: dict[int, list[tuple[int, int]]] = {}
            for octave, owners, tiles in suspects(words, min_length):
                for owner, tile in zip(owners.tolist(), tiles.tolist()):
                    found.setdefault(owner, []).append((octave, tile))
            del words
            rows = []
            for i, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), texts)):
                n = counts[i]
                if i not in found:
                    joined = b" ".join(text.split())
                    kept = hashlib.sha256(joined).hexdigest() if digest else joined.decode()
                    rows.append((doc_id, None, n, kept, None, None, None, None))
                    continue
                doc = xxhash.xxh3_128_digest(text)
                rows.append((doc_id, doc, n, text.decode(), None, None, None, None))
                number: dict[bytes, int] = {}
                ids = np.array([number.setdefault(w, len(number)) for w in text.split()], "<u4")
                for octave, tile in found[i]:
                    period = 1 << octave
                    size = tile_size(period)
                    first = max(0, tile * size - 2 * period)
                    own = ids[first : (tile + 1) * size + 3 * period]
                    rows.append((None, doc, n, None, octave, tile, first, own.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES_ARROW)], schema=_PIECES_ARROW)

    return run


def z_function(s: list[int]) -> list[int]:
    """For every place, how many items from there on equal those from the beginning on."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve(s: list[int], period: int, boundaries: range) -> dict[int, list[list[int]]]:
    """Matching intervals [low, high) at each period of an octave, around boundaries of a tile."""
    found: dict[int, list[list[int]]] = {}
    for c in boundaries:
        if s[c] not in s[c + period : c + 2 * period] and not (c and s[c - 1] in s[c - 1 + period : c - 1 + 2 * period]):
            continue  # no period has a match on either side
        after = z_function(s[c : c + 4 * period])
        low, top = max(0, c - 2 * period), min(len(s), c + 2 * period)
        before = z_function(s[low:c][::-1] + [-1] + s[low:top][::-1])
        for p in range(period, min(2 * period, top - c + 1)):
            right = min(after[p], 2 * period) if p < len(after) else 0
            left = before[c - low + 1 + top - c - p]
            if left + right >= p:
                spans = found.setdefault(p, [])
                if spans and spans[-1][1] >= c - left:
                    spans[-1][1] = max(spans[-1][1], c + right)
                else:
                    spans.append([c - left, c + right])
    return found


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, octave, tile, first, n, words in zip(*(batch.column(c).to_pylist() for c in ("doc", "octave", "tile", "first", "n_words", "words"))):
            period = 1 << octave
            size = tile_size(period)
            here = range(tile * size - first, min((tile + 1) * size, n) - first, period)
            for p, spans in solve(np.frombuffer(words, "<u4").tolist(), period, here).items():
                out += [(doc, p, first + low, first + high) for low, high in spans]
        columns = zip(*out) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MATCHES_ARROW)], schema=_MATCHES_ARROW)


def stitch(matches: DataFrame, min_length: int) -> DataFrame:
    """(doc, start, length, period): runs from the matching intervals of all tiles."""
    order = Window.partitionBy("doc", "period").orderBy("low", "high")
    reached = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce((F.col("low") > reached).cast("int"), F.lit(1))
    marked = matches.withColumn("apart", apart)
    marked = marked.withColumn("island", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy("doc", "period", "island").agg(F.min("low").alias("start"), F.max("high").alias("high"))
    runs = whole.select("doc", "period", "start", (F.col("high") - F.col("start") + F.col("period")).alias("length"))
    runs = runs.where((F.col("length") >= min_length) & (F.col("length") >= 2 * F.col("period")))
    return runs.groupBy("doc", "start", "length").agg(F.min("period").alias("period"))


def _collapse(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks.batched(batches, "text", _BLOCK):
            kept = []
            for text, runs in zip(chunks.encoded(batch.column("text")), batch.column("runs").to_pylist()):
                words, left, at = text.split(), [], 0
                for low, high in sorted((r["start"] + r["period"], r["start"] + r["length"]) for r in runs):
                    left += words[at:low]
                    at = max(at, high)
                joined = b" ".join(left + words[at:])
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("runs"), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, digest: bool = False, tables: Scratch | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): periodic runs of every whole text, and it without them.

    Words stand between ASCII white space. ``runs`` lists (start, length, period) in words, by
    start and then period: stretches of at least ``min_length`` words and two periods that cannot
    grow, at their smallest period. Words of a run after its first period go; the others are joined
    by one space in ``collapsed`` (with ``digest`` its SHA-256). A null or empty text has no words
    and no run. Every row is a document, repeated rows and null ids too. Columns other than doc_id
    and text are not read.
    """
    tables = tables or Scratch(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pieces = tables.store(slim.mapInArrow(_explode(min_length, digest), _PIECES), "tiles", "zstd")
    documents = pieces.where("octave IS NULL").select("doc_id", "doc", "n_words", "text")
    plain = documents.where("doc IS NULL").select("doc_id", "n_words", F.array().cast(_RUNS).alias("runs"), F.col("text").alias("collapsed"))
    # copies of a text made the same tiles
    tiles = pieces.where("octave IS NOT NULL").groupBy("doc", "octave", "tile").agg(F.first(F.struct("first", "n_words", "words")).alias("t"))
    matches = tiles.select("doc", "octave", "tile", "t.*").mapInArrow(_solve, _MATCHES)
    runs = stitch(matches, min_length).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    runs = runs.select("doc", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    suspected = documents.where("doc IS NOT NULL").join(runs, "doc", "left").withColumn("runs", F.coalesce("runs", F.array().cast(_RUNS)))
    schema = f"doc_id bigint, n_words bigint, runs {_RUNS}, collapsed string"
    collapsed = suspected.select("doc_id", "n_words", "text", "runs").mapInArrow(_collapse(digest), schema)
    return plain.unionByName(collapsed)
