"""Token ids in files: canonical Huffman codes from global counts, in independent blocks.

A data set of blocks is a folder with two parquet tables. ``codes`` has the code length of every
id; lengths alone define a canonical code. ``blocks`` has, in ascending order of documents, blocks
of about ``BLOCK_IDS`` ids: the documents in it with their numbers of ids, the bits, and bit
offsets of the start and of every 128th id of each document. Any block, and any stretch between
two offsets, is decoded without the ones before it. Parquet holds the bytes so that files are
written, committed and repeated after a loss as Spark does it, in any store it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thoughtlog.llm import chunks
from thoughtlog.llm.huffman import STEP, Coder, code_lengths
from thoughtlog.llm.token_ids import opened
from thoughtlog.llm.winnowing import in_id_ranges
from thoughtlog.sources.scratch import Scratch

BLOCK_IDS = 1 << 18
_BLOCK = "range_no int, before bigint, doc_ids array<bigint>, n_ids array<bigint>, offsets binary, bits binary"
_BLOCK_ARROW = pa.schema(
    [("range_no", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int64())), ("offsets", pa.binary()), ("bits", pa.binary())]
)


def _tokens(path: str, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = opened(path)
        for batch in chunks.batched(batches, "text", 4 << 20):
            data = [ids.of(text) + end for text in chunks.encoded(batch.column("text"))]
            every = np.frombuffer(b"".join(data), "<u4")
            narrow = bool(every.max(initial=0) < 65536)
            if narrow:
                short = every.astype("<u2").tobytes()
                ends = np.cumsum([len(d) // 2 for d in data]).tolist()
                data = [short[a:b] for a, b in zip([0, *ends[:-1]], ends)]
            width = pa.array(np.full(len(data), 2 if narrow else 4), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), width, pa.array(data, pa.binary())], ["doc_id", "width", "ids"])

    return run


def token_table(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, width, ids): ids of every whole text and the end id, as integers of width bytes."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return source.mapInArrow(_tokens(vocabulary, end_id), "doc_id bigint, width int, ids binary")


def _ids(row_width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if row_width == 2 else "<u4")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for width in (2, 4):
            parts = [d for d, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist()) if w == width]
            n = np.bincount(_ids(width, b"".join(parts)))
            if len(n) > len(total):
                n[: len(total)] += total
                total = n
            else:
                total[: len(n)] += n
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])


def count_ids(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents: counted in each task, then summed."""
    return tokens.select("ids", "width").mapInArrow(_count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            widths, data = (batch.column(n).to_pylist() for n in ("width", "ids"))
            n_ids = np.array([len(d) // w for d, w in zip(data, widths)], np.int64)
            narrow = set(widths) <= {2}
            ids = _ids(2, b"".join(data)) if narrow else np.concatenate([_ids(w, d).astype("<u4") for d, w in zip(data, widths)])
            coded = coder.encode_all(ids, n_ids)
            bits, offsets = [c[0] for c in coded], [c[1].astype("<u8").tobytes() for c in coded]
            columns = [batch.column("doc_id"), pa.array(n_ids, pa.int64()), pa.array(offsets, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "offsets", "bits"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join coded documents of one range, in order, into blocks."""
    range_no, before, held = None, 0, 0
    docs: list[tuple] = []

    def block() -> pa.RecordBatch:
        shift, offsets = 0, []
        for _, _, at, bits in docs:
            offsets.append(np.frombuffer(at, "<u8").astype(np.int64) + shift)
            shift += 8 * len(bits)
        row = {
            "range_no": range_no, "before": before, "doc_ids": [d[0] for d in docs], "n_ids": [d[1] for d in docs],
            "offsets": np.concatenate(offsets).astype("<u8").tobytes(), "bits": b"".join(d[3] for d in docs),
        }
        return pa.RecordBatch.from_pylist([row], _BLOCK_ARROW)

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("range_no", "doc_id", "n_ids", "offsets", "bits"))):
            if docs and (row[0] != range_no or held >= BLOCK_IDS):
                yield block()
                before, held, docs = before + held, 0, []
            if row[0] != range_no:
                range_no, before = row[0], 0
            docs.append(row[1:])
            held += row[2]
    if docs:
        yield block()


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, tables: Scratch | None = None) -> None:
    """Encode every whole text, append the end id, and write the data set at ``path``.

    Documents are in ascending doc_id, null first, rows of equal id in the order of their bits.
    Text is tokenized once; coded documents, not texts or ids, are shuffled into their order. A null
    or empty text is the end id alone; repeated rows are documents each; an empty table gives a
    data set without blocks. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    tables = tables or Scratch(spark)
    tokens = tables.store(token_table(docs, vocabulary, end_id), "tokens", compression="zstd")
    counts = count_ids(tokens).collect()  # one row for each id of the vocabulary at most
    table = np.zeros(max([r.id for r in counts], default=0) + 1, np.int64)
    for row in counts:
        table[row.id] = row.n
    lengths = code_lengths(table)
    codes = spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id bigint, bits int")
    codes.coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast(Coder(lengths))
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks.parts(int(table.sum()), 32 << 20))
    placed, _ = in_id_ranges(tokens, n_ranges)
    coded = placed.select("range_no", "doc_id", "width", "ids")
    coded = coded.mapInArrow(_with_range(_encode(shared)), "range_no int, doc_id bigint, n_ids bigint, offsets binary, bits binary")
    ordered = coded.repartitionById(n_ranges, F.col("range_no")).sortWithinPartitions("range_no", F.col("doc_id").asc_nulls_first(), "bits")
    ordered.mapInArrow(_blocks, _BLOCK).write.parquet(f"{path}/blocks")


def _with_range(encode):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks.batched(batches, "ids", 4 << 20):
            for out in encode(iter([batch])):
                yield pa.RecordBatch.from_arrays([batch.column("range_no"), *out.columns], ["range_no", *out.schema.names])

    return run


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                n_ids = np.array(row["n_ids"], np.int64)
                lanes = -(-n_ids // STEP)
                owner = np.repeat(np.arange(len(n_ids)), lanes)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
                counts = np.minimum(n_ids[owner] - place * STEP, STEP)
                ids = coder.decode(row["bits"], np.frombuffer(row["offsets"], "<u8").astype(np.int64), counts)
                ends = np.cumsum(n_ids)
                parts = [ids[b - n : b].astype("<u4").tobytes() for n, b in zip(n_ids.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n_ids), row["range_no"]), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                        pa.array(ends - n_ids + row["before"], pa.int64()), pa.array(n_ids), pa.array(parts, pa.binary()),
                    ],
                    ["range_no", "doc_id", "place", "n_tokens", "ids"],
                )

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): documents of a data set, ``start`` the ids before each.

    ``ids`` are little-endian unsigned 32-bit integers. Blocks are decoded where they are read. There
    is a row for each row that was written, with its id, null ids first; a data set without blocks
    gives no row.
    """
    codes = spark.read.parquet(f"{path}/codes").collect()  # one row for each id of the vocabulary
    lengths = np.zeros(max([r.id for r in codes], default=0) + 1, np.int64)
    for row in codes:
        lengths[row.id] = row.bits
    shared = spark.sparkContext.broadcast(Coder(lengths))
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.groupBy("range_no").agg(F.sum(F.aggregate("n_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    starts = sizes.select("range_no", (F.sum("n").over(Window.orderBy("range_no")) - F.col("n")).alias("range_start"))
    decoded = blocks.mapInArrow(_decode(shared), "range_no int, doc_id bigint, place bigint, n_tokens bigint, ids binary")
    joined = decoded.join(F.broadcast(starts), "range_no")  # a row for each range of the files
    return joined.select("doc_id", (F.col("place") + F.col("range_start")).alias("start"), "n_tokens", "ids")
