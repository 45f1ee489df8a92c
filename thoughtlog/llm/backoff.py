"""Language-model scores by stupid backoff, with counts from the whole corpus.

The counts of all n-grams up to an order are tables partitioned by the n-gram's hash: chunks of
documents send their distinct n-grams with counts to the shards, a shard adds up what all chunks
sent, and the totals come back to the chunks in the order in which they were asked for. There
every document's n-grams are looked up and their scores summed. A document's own occurrences are
taken off first, so it is scored by what the *other* documents say.

S(w | h) is count(h w) / count(h) for the longest history h with count(h w) > 0, times ``alpha``
for every word that the history was cut by; with no history left, count(w) / N, and for a word
that nobody else has, alpha / N.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thoughtlog.llm import chunks
from thoughtlog.llm.words import BETWEEN_SPACES, Words
from thoughtlog.sources.scratch import Scratch

ORDER, ALPHA = 3, 0.4
MAX_BUCKETS = 100_000  # what Spark allows by default
CHUNK_BYTES = 8 << 20  # larger chunks have fewer distinct n-grams for a byte of text

_SENT = "shard bigint, chunk bigint, keys binary, n binary"
_SENT_ARROW = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])
_TOTALS = "shard bigint, chunk bigint, elsewhere binary"
_TOTALS_ARROW = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("elsewhere", pa.binary())])
_SCORES = "doc_id bigint, n_words bigint, log_score double, mean_log_score double, n_backed_off bigint"
_SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64()), ("n_backed_off", pa.int64())])


def _words(texts: list[bytes]) -> Words:
    return Words([t.lower() for t in texts], BETWEEN_SPACES)


def _grams(words: Words, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(starts, hashes) for every length; lengths have hashes of their own."""
    return [words.windows(n) for n in range(1, order + 1)]


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.sort(hashes)
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[first], np.diff(np.concatenate([first, [len(hashes)]]))


def _send(order: int, n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, _, texts in chunks.unpacked(batch):
                words = _words(texts)
                if not len(words.hashes):
                    continue
                keys, n = _distinct(np.concatenate([h for _, h in _grams(words, order)]))
                rows = [row | {"keys": chunks.tight(row["keys"]), "n": chunks.tight(chunks.planes(row["n"]))} for row in chunks.packed(chunk, keys, n_shards, n=n)]
                yield pa.RecordBatch.from_pylist(rows, _SENT_ARROW)

    return run


def _add_up(key: tuple, table: pa.Table) -> pa.Table:
    """Counts of each chunk's keys in all other chunks, in the order of its keys."""
    sent = [chunks.unsqueezed(chunks.loose(k)) for k in table.column("keys").to_pylist()]
    counts = [chunks.unplaned(chunks.loose(n)) for n in table.column("n").to_pylist()]
    every = np.concatenate(sent)
    order = np.argsort(every, kind="stable")
    ordered, running = every[order], np.cumsum(np.concatenate(counts)[order])
    last = np.flatnonzero(np.concatenate([ordered[1:] != ordered[:-1], [True]]))
    keys, totals = ordered[last], np.diff(np.concatenate([[0], running[last]]))
    rows = []
    for chunk, own, n in zip(table.column("chunk").to_pylist(), sent, counts):
        elsewhere = totals[np.searchsorted(keys, own)] - n
        rows.append({"shard": key[0].as_py(), "chunk": chunk, "elsewhere": chunks.tight(chunks.planes(elsewhere))})
    return pa.Table.from_pylist(rows, _TOTALS_ARROW)


def _score(order: int, alpha: float, total: int):
    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SCORES_ARROW.empty_table()
        _, doc_ids, texts = next(chunks.unpacked(docs))
        words = _words(texts)
        n_words = words.counts()
        sums, backed = np.zeros(len(n_words)), np.zeros(len(n_words), np.int64)
        if len(words.hashes):
            grams = _grams(words, order)
            keys, n = _distinct(np.concatenate([h for _, h in grams]))
            answers = totals.sort_by("shard").column("elsewhere").to_pylist()
            count = n + np.concatenate([chunks.unplaned(chunks.loose(a)) for a in answers])
            owner = np.repeat(np.arange(len(n_words)), n_words)
            # others[k][i]: how often other documents have the k + 1 words from word i on
            others = []
            for starts, hashes in grams:
                at = np.searchsorted(keys, hashes)
                pair = owner[starts] * len(keys) + at
                own, times = _distinct(pair.astype(np.uint64))
                mine = times[np.searchsorted(own, pair.astype(np.uint64))]
                full = np.zeros(len(words.hashes), np.int64)
                full[starts] = count[at] - mine
                others.append(full)
            rest = np.maximum(total - n_words[owner], 1)
            place = np.arange(len(owner)) - words.first[:-1][owner]
            value = np.log(np.maximum(others[0], alpha)) - np.log(rest)
            used = np.zeros(len(owner), np.int64)
            for k in range(1, order):
                i = np.flatnonzero(place >= k)
                seen, history = others[k][i - k], others[k - 1][i - k]
                ok = seen > 0
                value[i[ok]], used[i[ok]] = np.log(seen[ok] / history[ok]), k
            cut = np.minimum(place, order - 1) - used
            value += cut * np.log(alpha)
            sums = np.bincount(owner, value, len(n_words))
            backed = np.bincount(owner, cut > 0, len(n_words)).astype(np.int64)
        mean = np.divide(sums, n_words, out=np.zeros(len(sums)), where=n_words > 0)
        columns = [doc_ids, pa.array(n_words, pa.int64()), pa.array(sums), pa.array(mean), pa.array(backed, pa.int64())]
        return pa.table(columns, schema=_SCORES_ARROW)

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = sum(len(t.split()) for _, _, texts in chunks.unpacked(batch) for t in texts)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, tables: Scratch | None = None) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score, n_backed_off): one row per document.

    Words stand between ASCII white space, A-Z lower-cased; histories do not cross documents. The
    log is natural; a null or empty text has no words and scores 0. Rows are documents, so a
    repeated row is scored by its twin. Counts are of all documents. Columns
    other than doc_id and text are not read.
    """
    tables = tables or Scratch(docs.sparkSession)
    n_chunks = chunks.parts(chunks.text_bytes(docs), CHUNK_BYTES)
    buckets = min(max(n_chunks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MAX_BUCKETS)
    # in buckets of chunks, so that the answers come to the texts and these are not shuffled
    packs = tables.store_bucketed(chunks.pack_documents(docs, CHUNK_BYTES), "chunks", "chunk", buckets, "none")
    size = packs.agg(F.sum("size")).first()[0] or 0
    total = packs.mapInArrow(_count_words, "n bigint").agg(F.sum("n")).first()[0] or 0
    sent = packs.mapInArrow(_send(order, chunks.parts(size, chunks.SHARD_BYTES)), _SENT)
    totals = sent.groupBy("shard").applyInArrow(_add_up, _TOTALS)
    return packs.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(_score(order, alpha, total), _SCORES)
