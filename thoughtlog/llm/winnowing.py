"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of every window of w hashes the least is chosen,
the rightmost if several are equal, and kept with its position. Texts that share a passage of
``w + k - 1`` code points share at least one fingerprint inside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thoughtlog.functions.ranges import place_among, quantile_bounds
from thoughtlog.llm import chunks
from thoughtlog.llm.words import mix

GRAM, WINDOW = 16, 64
#: Short texts too keep several hashes: a shared passage of 15 code points shares one.
DENSE_GRAM, DENSE_WINDOW = 8, 8
_BLOCK = 1 << 20  # code points hashed at once
_PLACE_BITS = 22
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k code points, put together from runs of doubled length."""
    whole, size = None, 0
    run, run_size, left = mix(points.astype(np.uint64) + np.uint64(1)), 1, k
    while left:
        if left & 1:
            n = len(points) - size - run_size + 1
            shift = np.uint64(pow(_BASE, run_size, 2**64))
            whole = run[:n] if whole is None else whole[:n] * shift + run[size : size + n]
            size += run_size
        left >>= 1
        if left:
            shift = np.uint64(pow(_BASE, run_size, 2**64))
            run = run[: len(run) - run_size] * shift + run[run_size:]
            run_size *= 2
    return mix(whole)


def choose(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the rightmost least hash of every window; fewer hashes than w are one window.

    A place is part of the sorted number, counted from the right, so equal hashes go to the
    rightmost; hashes are compared by their upper bits.
    """
    n = len(hashes)
    w = min(w, n)
    places = np.arange(n, dtype=np.uint64)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = (hashes & ~low) | (low - places)
    size = 1
    while size < w:
        step = min(size, w - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    return np.unique((low - (least & low)).astype(np.int64))


def winnow(points: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a text; shorter than k code points: the hash of all of it.

    A very long text is worked in blocks that overlap by a window, which gives the same choice.
    """
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(k, len(points))
    hashes = gram_hashes(points, k)
    if len(hashes) <= _BLOCK:
        at = choose(hashes, w)
    else:
        blocks = range(0, len(hashes) - w + 1, _BLOCK)
        at = np.unique(np.concatenate([choose(hashes[b : b + _BLOCK + w - 1], w) + b for b in blocks]))
    return hashes[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted sets; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def fingerprint_text(hashes: np.ndarray) -> str:
    """Chosen hashes in order of position, 16 hexadecimal digits each."""
    return hashes.astype(">u8").tobytes().hex()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _fingerprints(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, positions = [], []
            for text in chunks.strings(batch.column("text")):
                h, at = winnow(_points(text), k, w)
                hashes.append(h.view(np.int64))
                positions.append(at)
            columns = [batch.column("doc_id"), pa.array(hashes, pa.list_(pa.int64())), pa.array(positions, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hashes", "positions"])

    return run


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """(doc_id, hashes, positions): chosen hashes of every whole text and where they start, in
    order. A null or empty text has none."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(k, w), f"doc_id {kind}, hashes array<bigint>, positions array<bigint>")


def in_id_ranges(docs: DataFrame, n_ranges: int) -> tuple[DataFrame, DataFrame]:
    """The rows with a ``range_no`` by ranges of doc_id of about equal counts, and
    (range_no, last, n) of the ranges that have rows.

    Bounds come from quantiles of the ids alone; the driver sees one number for each range. A
    null id is in the first range.
    """
    where = place_among(F.col("doc_id"), quantile_bounds(docs, "doc_id", n_ranges))
    placed = docs.withColumn("range_no", where.cast("int"))
    ends = placed.groupBy("range_no").agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    return placed, ends


def _compare(k: int, w: int):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the next document in descending order is the one before in ascending order
        for batch in batches:
            rows = []
            columns = (batch.column(n).to_pylist() for n in ("halo", "doc_id"))
            for halo, doc_id, text in zip(*columns, chunks.strings(batch.column("text"))):
                points = _points(text)
                hashes, at = winnow(points, k, w)
                own = np.unique(hashes)
                if not halo:
                    next_points, next_own = before if before is not None else (points, own)
                    half = len(points) // 2
                    start = next_points[:half]
                    edited = np.concatenate([points[: len(points) - half], start]) if half else points
                    edited_hashes, _ = winnow(edited, k, w)
                    digest = hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest()
                    rows.append((doc_id, len(points), digest, fingerprint_text(hashes), fingerprint_text(edited_hashes), likeness(own, np.unique(edited_hashes)), likeness(own, next_own), at))
                before = (points, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def compare_edited(docs: DataFrame, k: int = GRAM, w: int = WINDOW, range_bytes: int = 64 << 20) -> DataFrame:
    """Fingerprints of every text, of its edited form and of the next document, and how alike.

    The next document is the one with the next smaller doc_id, after the smallest the largest;
    rows with equal ids stand in the order of their texts. The edited text has the last
    floor(n/2) code points replaced by as many first ones of the next document, or all it has.
    A null text is empty; a null id is below every other; a single row is its own next.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    spark = docs.sparkSession
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks.parts(chunks.text_bytes(docs), range_bytes))
    placed, ends = in_id_ranges(docs, n_ranges)
    # One row for each range. The largest row of a range is wanted by the next one too, as its
    # halo, and the largest of all by the first.
    last = ends.orderBy("range_no").collect()
    if not last:
        return spark.createDataFrame([], "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<bigint>")
    wanted = {r.range_no: last[(i + 1) % len(last)].range_no for i, r in enumerate(last)}
    goes = spark.createDataFrame([(r.range_no, wanted[r.range_no], r.last) for r in last], "from_no int, to_no int, last bigint")
    halo = placed.join(F.broadcast(goes), (F.col("range_no") == F.col("from_no")) & F.col("doc_id").eqNullSafe(F.col("last")))
    halo = halo.groupBy("to_no").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "doc_id")).alias("m"))
    halo = halo.select(F.col("to_no").alias("range_no"), F.lit(True).alias("halo"), F.col("m.doc_id").alias("doc_id"), F.col("m.text").alias("text"))
    rows = placed.select("range_no", F.lit(False).alias("halo"), "doc_id", "text").union(halo)
    ordered = rows.repartitionById(n_ranges, F.col("range_no")).sortWithinPartitions(F.col("halo").desc(), F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<bigint>"
    return ordered.mapInArrow(_compare(k, w), schema)
