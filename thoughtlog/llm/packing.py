"""Best-two-fit packing of documents into sequences of fixed length.

Pieces are dealt into groups of bounded size by a hash, and each group is packed on its own, so
no task depends on the size of the corpus; a group costs at most one sequence that is not full.
Inside a group only the lengths matter: equal lengths are interchangeable. A sequence is filled
greedily, each time by the longest piece that fits. Then its smallest piece is taken out again if
two unpacked pieces fill the widened gap more tightly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thoughtlog.llm import chunks
from thoughtlog.llm.token_ids import opened

GROUP = 32_768
_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences as lists of lengths; every length is at most the capacity."""
    count = np.bincount(lengths, minlength=capacity + 1).tolist()
    left, present = len(lengths), 0  # present: bit L is set while a piece of length L is left
    for length in np.flatnonzero(np.bincount(lengths)).tolist():
        present |= 1 << length

    def take(length: int) -> None:
        nonlocal present, left
        count[length] -= 1
        left -= 1
        if not count[length]:
            present ^= 1 << length

    def give(length: int) -> None:
        nonlocal present, left
        if not count[length]:
            present |= 1 << length
        count[length] += 1
        left += 1

    def longest(most: int) -> int:
        """Longest length left that is at most this, 0 if there is none."""
        return max(0, (present & ((2 << most) - 1)).bit_length() - 1)

    def best_two(gap: int, more_than: int) -> tuple[int, int] | None:
        """Two pieces left that fill the gap best, if they fill more than the given."""
        best, pair, a = more_than, None, longest(gap - 1)
        while a and 2 * a > best:
            b = longest(min(a, gap - a)) if gap > a else 0
            if b == a and count[a] < 2:
                b = longest(a - 1)
            if b and a + b > best:
                best, pair = a + b, (a, b)
                if best == gap:
                    break
            a = longest(a - 1)
        return pair

    out = []
    while left:
        row, gap = [], capacity
        while (length := longest(gap)) and gap:
            take(length)
            row.append(length)
            gap -= length
        if gap and left > 1:
            smallest = row[-1]
            if pair := best_two(gap + smallest, smallest):
                row.pop()
                give(smallest)
                for length in pair:
                    take(length)
                row += pair
        out.append(row)
    return out


def _pieces(path: str, capacity: int, end_id: int):
    end = end_id.to_bytes(4, "little")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = opened(path)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), chunks.encoded(batch.column("text"))):
                data = ids.of(text) + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for values, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, schema)], schema=schema)

    return run


def _group(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        rows = pack_lengths(lengths, capacity)
        flat = np.array([x for row in rows for x in row], np.int64)
        sizes = np.array([len(row) for row in rows])
        ends = np.cumsum(flat)
        row_start = np.repeat(np.concatenate([[0], ends[np.cumsum(sizes)[:-1] - 1]]), sizes)
        # Pieces and places of one length meet in order.
        place, piece = np.argsort(flat, kind="stable"), np.argsort(lengths, kind="stable")
        sequence, offset = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
        sequence[piece] = np.repeat(np.arange(len(rows)), sizes)[place]
        offset[piece] = (ends - flat - row_start)[place]
        out = table.drop_columns(["group"])
        out = out.append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 32)))
        return out.append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    A document is the ids of its whole text and ``end_id``; a null or empty text is the end id
    alone. Only documents longer than ``capacity`` are cut, into pieces of that length. Repeated
    rows are packed as often as they occur; a null doc_id stays null. Other columns are not read.
    """
    sizes = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n_groups = chunks.parts(sizes.n + (sizes.b or 0) // capacity, group)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pieces = source.mapInArrow(_pieces(vocabulary, capacity, end_id), _PIECE)
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_groups)))
    return dealt.groupBy("group").applyInArrow(_group(capacity), _PIECE + ", sequence_id bigint, offset bigint")
