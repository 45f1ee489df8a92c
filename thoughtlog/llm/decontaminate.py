"""Benchmark passages in documents, found through an FM-index of each training shard.

A shard is some megabytes of documents, indexed where they are scanned: nothing is shuffled.
All test phrases are searched backwards at once through wavelet-matrix ranks; what occurs is
located by sampled suffix positions, and overlapping places are merged into removal spans. The
phrases are a stated query set. They go to the tasks in blocks of bounded size; several blocks
are searched in the same index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from thoughtlog.llm import chunks
from thoughtlog.llm.fm_index import FMIndex
from thoughtlog.llm.words import ALPHANUMERIC, Words

SHARD_BYTES = 4 << 20
BLOCK_BYTES = 64 << 20


def phrases(ids: list[str], texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Distinct windows of n words, right-aligned, their lengths, and the ids of their items.

    A text of fewer words, but not none, is one window.
    """
    words = Words(texts, ALPHANUMERIC)
    rows: dict[bytes, list[str]] = {}
    for item, (a, b) in zip(ids, zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        size = min(n, b - a)
        for start in range(a, b - size + 1) if size else ():
            holders = rows.setdefault(words.hashes[start : start + size].tobytes(), [])
            if not holders or holders[-1] != item:
                holders.append(item)
    matrix, lengths = np.zeros((len(rows), n), np.uint64), np.zeros(len(rows), np.int64)
    for i, key in enumerate(rows):
        lengths[i] = len(key) // 8
        matrix[i, n - lengths[i] :] = np.frombuffer(key, np.uint64)
    return matrix, lengths, list(rows.values())


def _search(words: Words, blocks: list[Broadcast]) -> tuple[np.ndarray, list[set[str]]]:
    """For a shard: which words are hit, and the items found in each text."""
    first, n_texts = words.first, len(words.first) - 1
    hit, items = np.zeros(len(words.hashes) + 1, np.int64), [set() for _ in range(n_texts)]
    index = FMIndex(words.hashes, first) if len(words.hashes) and blocks else None
    for block in blocks if index else ():
        matrix, lengths, holders = block.value
        pattern, low, high = index.find(matrix, lengths)
        which, place = index.locate(low, high)
        pattern = pattern[which]
        text = np.searchsorted(first[:-1] + np.arange(n_texts), place, "right") - 1
        word = place - text
        np.add.at(hit, word, 1)
        np.add.at(hit, word + lengths[pattern], -1)
        for t, p in set(zip(text.tolist(), pattern.tolist())):
            items[t].update(holders[p])
    return np.cumsum(hit)[:-1] > 0, items


def _without(text: bytes, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> bytes:
    """The text without its runs of hit words, from the first byte of a run to its last."""
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        out.append(text[at : int(starts[a])])
        at = int(ends[b - 1])
    return b"".join(out) + text[at:]


def _task(blocks: list[Broadcast], names: list[str], remove: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in chunks.batched(batches, "text", SHARD_BYTES):
            waiting.append(batch)
            size += batch.column("text").nbytes
            if size >= SHARD_BYTES:
                yield from one(pa.Table.from_batches(waiting))
                waiting, size = [], 0
        if waiting:
            yield from one(pa.Table.from_batches(waiting))

    def one(docs: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = chunks.encoded(docs.column("text"))
        words = Words(texts, ALPHANUMERIC)
        hit, items = _search(words, blocks)
        before = np.concatenate([[0], np.cumsum(hit)])
        n_hit = before[words.first[1:]] - before[words.first[:-1]]
        columns = {n: docs.column(n) for n in names}
        if remove:
            cleaned = []
            for i, (text, n) in enumerate(zip(texts, n_hit.tolist())):
                if n:
                    a, b = words.first[i], words.first[i + 1]
                    at = words.offsets[i]
                    text = _without(text, words.starts[a:b] - at, words.ends[a:b] - at, hit[a:b])
                cleaned.append(text)
            mask = docs.column("text").is_null().to_numpy()
            columns["text"] = pa.array(cleaned, pa.binary(), mask=mask).cast(pa.string())
        columns["n_words"] = pa.array(words.counts(), pa.int64())
        columns["n_hit"] = pa.array(n_hit, pa.int64())
        columns["items"] = pa.array([sorted(s) for s in items], pa.list_(pa.string()))
        yield from pa.table(columns).to_batches()

    return run


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = 10, remove: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every document; ``items`` holds the ids of benchmark
    items with a window in it, as strings in string order.

    A word is a run of letters a-z, digits and non-ASCII characters after lower-casing A-Z. A
    window is ``window`` consecutive words of an item, or a shorter item's all. With ``remove``
    all input columns are returned, the text without its hit words and what stands between
    neighbouring ones; n_words, n_hit and items replace columns of those names. A null text stays
    null and has no word; null items and items without words are never found; an item with a null
    id is called "null"; items with equal ids count once. The benchmark's rows are the queries:
    they are read block by block, each of about ``BLOCK_BYTES`` of text, and sent to the tasks.
    """
    n_blocks = chunks.parts(chunks.text_bytes(benchmark), BLOCK_BYTES)
    queries = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    queries = chunks.chunked(queries, "block", n_blocks, ("item_id", "text"))
    blocks = []
    for block in range(n_blocks):
        rows = queries.where(F.col("block") == block).collect()
        found = phrases([r.item_id for r in rows], [(r.text or "").encode() for r in rows], window)
        if len(found[0]):
            blocks.append(docs.sparkSession.sparkContext.broadcast(found))
    own = ("n_words", "n_hit", "items")
    source = docs if remove else docs.select("doc_id", "text")
    source = source.select(*[F.col(f"`{c}`") for c in source.columns if c not in own])
    others = [f for f in source.schema if f.name != "text"]
    schema = StructType(list(others))
    if remove:
        schema = schema.add("text", "string")
    schema = schema.add("n_words", "long").add("n_hit", "long").add("items", ArrayType(StringType()))
    return source.mapInArrow(_task(blocks, [f.name for f in others], remove), schema)
