"""Documents in chunks, keys in shards.

Operators that must know how often something occurs in the whole corpus work in three steps:
each chunk of documents sends its *distinct* keys, as packed arrays, to the shards of the key
space; a shard merges what all chunks sent; the answers go back to the chunks, which hold the
texts. A key that a third of all documents share is thus sent once per chunk, never once per
document, and no step gathers the rows of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
SHARD_BYTES = 8 << 20
LEVEL = 6  # of the compression of chunks, which are stored once and shuffled twice


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one scan of one column."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def chunked(docs: DataFrame, chunk: str, n_chunks: int, keys: tuple[str, ...]) -> DataFrame:
    """Add the chunk number: a hash of the given columns, so that any run gives the same, and
    neither null ids nor a hot source fill one chunk."""
    place = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(n_chunks))
    return docs.withColumn(chunk, place)


def parts(total_bytes: int, each: int) -> int:
    return max(1, -(-total_bytes // each))


def by_shard(hashes: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of every hash: the hash scaled to the number of shards, so sorted hashes are in shard
    order."""
    top = (hashes >> np.uint64(32)).astype(np.uint64)
    return ((top * np.uint64(n_shards)) >> np.uint64(32)).astype(np.int64)


def packed(
    chunk: int, hashes: np.ndarray, n_shards: int, **values: np.ndarray
) -> Iterator[dict[str, object]]:
    """Rows (shard, chunk, keys, values ...) from sorted distinct hashes of one chunk; the values
    are still arrays."""
    shards = by_shard(hashes, n_shards)
    first = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else shards
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(shards)]):
        yield {"shard": int(shards[a]), "chunk": chunk, "keys": squeezed(hashes[a:b])} | {k: v[a:b] for k, v in values.items()}


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte: the upper bytes are zero and compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unsqueezed(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64)
    return np.cumsum(steps.ravel(), dtype=np.uint64)


def planes(values: np.ndarray) -> bytes:
    """Small numbers byte by byte, in as many bytes as the largest needs; the first byte says
    how many. Bytes that are mostly zero compress away."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    rows = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(rows.T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, : data[0]] = rows.T
    return out.view("<i8").ravel()


def tight(data: bytes) -> bytes:
    """Packed numbers with their entropy taken out, which the exchange's own compression leaves in;
    the first four bytes are the length."""
    return len(data).to_bytes(4, "little") + pa.compress(data, "zstd", asbytes=True)


def loose(data: bytes) -> bytes:
    return pa.decompress(data[4:], int.from_bytes(data[:4], "little"), "zstd", asbytes=True)


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts of a column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def encoded(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of a column's texts, null as empty."""
    kind = pa.binary() if pa.types.is_string(column.type) else pa.large_binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def batched(tables: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most about `most` bytes of text; a longer text is a slice of its own."""
    for batch in tables:
        sizes = np.array(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(False), np.int64)
        block = np.cumsum(sizes) // most if len(sizes) else sizes
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(sizes)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b > a:
                yield batch.slice(a, b - a)


PACKED = "chunk bigint, doc_ids array<bigint>, ends binary, size bigint, data binary"
_PACKED_ARROW = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.binary()), ("size", pa.int64()), ("data", pa.binary())])


def _pack(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            data = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts]).astype("<i8").tobytes()
            packed = pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True)
            return pa.RecordBatch.from_pylist([{"chunk": number, "doc_ids": ids, "ends": ends, "size": len(data), "data": packed}], _PACKED_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text"))):
                if texts and held + len(text) > most:
                    yield row()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
        if texts:
            yield row()

    return run


def pack_documents(docs: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """Rows of about so many bytes of text, compressed, in the order in which documents are read.

    A longer text is a row of its own. Rows do not depend on what documents hold, so copies of a
    row never gather in one chunk; and later steps shuffle the compressed form. Store the result:
    the numbers of chunks are those of one run.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(_pack(most), PACKED)


def unpacked(table: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, pa.Array, list[bytes]]]:
    """(chunk, doc_ids, texts) of packed rows, one at a time."""
    for i in range(table.num_rows):
        size = table.column("size")[i].as_py()
        data = pa.decompress(table.column("data")[i].as_py(), size, "zstd", asbytes=True)
        ends = np.frombuffer(table.column("ends")[i].as_py(), "<i8").tolist()
        yield table.column("chunk")[i].as_py(), table.column("doc_ids")[i].values, [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]
