"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a variant in common that differs from each
in at most r. So every *distinct* fingerprint emits all its variants within r bits, a shuffle
brings equal variants together, and fingerprints that meet there are linked after their distance
has been checked. At most ``1 + 64`` distinct fingerprints can share a variant at r = 1, so no
group is large, whatever number of documents share a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thoughtlog.llm import chunks
from thoughtlog.llm.components import components
from thoughtlog.llm.words import SPACES, mix
from thoughtlog.sources.scratch import Scratch

SEED = 42
_SLICE = 1 << 19


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> list[int]:
    """XXH64 of every run of ``words`` words, repeats included; fewer words are one run."""
    found = text.lower().split()  # bytes: A-Z and ASCII space only, as SPACES lists it
    if not found:
        return []
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())]


def bit_majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text, the word whose bits are set in over half of its hashes; no hash: zero."""
    out = np.zeros(len(counts), np.uint64)
    has = np.flatnonzero(counts)
    if not len(has):
        return out
    first = np.concatenate([[0], np.cumsum(counts[has])])[:-1]
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.uint32)
    set_ = 2 * ones.astype(np.int64) > counts[has, None]
    out[has] = np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _fingerprinter(text: str, words: int, seed: int, more: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks.batched(batches, text, _SLICE):
            per_text = [shingle_hashes(t, words, seed) for t in chunks.encoded(batch.column(text))]
            counts = np.fromiter(map(len, per_text), np.int64, len(per_text))
            flat = np.fromiter((h for one in per_text for h in one), np.uint64, int(counts.sum()))
            names, columns = list(batch.schema.names), list(batch.columns)
            keep = [i for i, n in enumerate(names) if n != text]
            arrays = [columns[i] for i in keep]
            words_out = [bit_majorities(flat, counts)]
            for lane in range(more):
                words_out.append(bit_majorities(mix(flat ^ np.uint64(0xA24BAED4963EE407 * (lane + 1) % 2**64)), counts))
            arrays += [pa.array(w.view(np.int64)) for w in words_out]
            labels = [names[i] for i in keep] + ["fingerprint"] + [f"fingerprint_{i + 1}" for i in range(more)]
            yield pa.RecordBatch.from_arrays(arrays, labels)

    return run


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", seed: int = SEED, more: int = 0) -> DataFrame:
    """Replace the text by its SimHash as BIGINT ``fingerprint``, where the document lies.

    Texts are whole, A-Z lower-cased, split at ASCII white space. A null or empty text, or one
    without words, has fingerprint zero. ``more`` adds independent words of 64 bits each.
    """
    rest = [f for f in docs.schema if f.name != text]
    schema = StructType(list(rest)).add("fingerprint", "long")
    for lane in range(more):
        schema = schema.add(f"fingerprint_{lane + 1}", "long")
    return docs.mapInArrow(_fingerprinter(text, words, seed, more), schema)


def variants(fingerprint: str, bits: int = 64, radius: int = 1) -> F.Column:
    """Array of all words within ``radius`` bits of a BIGINT column, itself first."""
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << b for b in c) for c in combinations(range(bits), r)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in signed]), lambda m: F.col(fingerprint).bitwiseXOR(m))


def ball_links(distinct: DataFrame, radius: int = 1, bits: int = 64) -> DataFrame:
    """Links (a, b) between distinct fingerprints that differ in at most ``2 * radius`` bits.

    Members of one variant are all linked to the least of them: any two of them are within
    ``2 * radius`` of each other, so those links reach whatever all pairs would. The least member
    comes from an aggregation with partial results and meets the variants again in a join.
    """
    each = distinct.select("fingerprint", F.explode(variants("fingerprint", bits, radius)).alias("variant"))
    met = each.groupBy("variant").agg(F.collect_set("fingerprint").alias("met")).where(F.size("met") > 1)
    pairs = met.select(F.explode("met").alias("a"), F.array_min("met").alias("b")).where("a != b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2 * radius)


def near_duplicate_groups(docs: DataFrame, words: int = 3, radius: int = 1, doc_id: str = "doc_id", text: str = "text", tables: Scratch | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per document.

    Documents whose fingerprints differ in at most ``2 * radius`` bits are linked; the component
    is the least id that can be reached, itself included. Documents without words have
    fingerprint zero and link like any other. Equal fingerprints are one node, so groups of
    copies cost no pairs. Rows with a null id get a component of the others in their group, or
    null if all of them are null; repeated rows give repeated rows. Other columns are not read.
    """
    tables = tables or Scratch(docs.sparkSession)
    marked = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words)
    marked = tables.store(marked, "fingerprints")
    nodes = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    nodes = tables.store(nodes, "nodes")
    roots = components(docs.sparkSession, ball_links(nodes, radius), tables)
    rooted = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.select("fingerprint", "root").join(named, "root").select("fingerprint", "component_id")
    return marked.join(known, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each_group(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents whose id is that of their group; rows without an id stay."""
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti")


# Near copies by similarity of word shingles. At five words a copy with every thirtieth word
# changed differs in about one bit in seven, too many for one fingerprint's ball. So several short
# fingerprints are used, each inside the documents that share two least shingle hashes: two texts
# of similarity s agree on those with chance s * s, and unrelated texts nearly never do, however
# large the corpus is. Two texts meet first if they share such a key and their short fingerprints there
# have a variant in common, that is, differ in at most two bits; what these balls part, a third to a
# half of the keys of two texts at similarity 0.8, meets in the later rounds by the key alone. No key
# of KEYS is shared with chance (1 - s * s) ** KEYS, at 0.8 two in 10 ** 11. Pairs that meet are verified
# by their shingles, after a sketch of these has shown that they can be alike.

KEYS, SHORTS, KEY_BITS = 24, 8, 16
PIVOTS = 64
_ODD = mix(np.arange(1, 2 * KEYS + 1, dtype=np.uint64)) | np.uint64(1)
SKETCH_BITS = 512
_SKETCH = [f"sketch_{i}" for i in range(SKETCH_BITS // 64)]


def _flat(per_text: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, per_text), np.int64, len(per_text))
    return np.fromiter((h for one in per_text for h in one), np.uint64, int(counts.sum())), counts


def _node(text: bytes) -> int:
    """Texts with the same words, A-Z lower-cased, are one node."""
    return xxhash.xxh3_64_intdigest(b" ".join(text.lower().split())) - 2**63


def short_fingerprints(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text, KEYS keys (of two least hashes) and the short fingerprint that counts there, one of
    SHORTS in turn."""
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    lanes = [bit_majorities(flat if i == 0 else mix(flat ^ _ODD[i]), counts) for i in range(-(-SHORTS * KEY_BITS // 64))]
    keys, shorts = np.empty((len(counts), KEYS), np.uint64), np.empty((len(counts), KEYS), np.int32)
    for k in range(KEYS):
        least = [np.minimum.reduceat(flat * _ODD[2 * k + i] >> np.uint64(1), first) for i in (0, 1)]
        keys[:, k] = mix(mix(least[0] ^ mix(least[1] + np.uint64(k))) + np.uint64(k))
        bit = k % SHORTS * KEY_BITS
        shorts[:, k] = lanes[bit // 64] >> np.uint64(bit % 64) & np.uint64(2**KEY_BITS - 1)
    return keys, shorts


def odd_sketches(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per set of hashes, SKETCH_BITS bits: whether an odd number of them falls on the bit.

    What two sets share cancels out, so two sketches differ in no more bits than the sets do in
    items, whatever the sets' size.
    """
    at = np.repeat(np.arange(len(counts)) * SKETCH_BITS, counts) + (flat % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(at, minlength=len(counts) * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).reshape(len(counts), len(_SKETCH))


def _keyed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks.batched(iter([batch]), "text", _SLICE):
                texts = chunks.encoded(part.column("text"))
                # distinct ones, as verification takes them: a repeated passage must not part two texts
                keys, shorts = short_fingerprints(*_flat([list(set(shingle_hashes(t, words))) or [0] for t in texts]))
                offsets = pa.array(np.arange(len(texts) + 1) * KEYS, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (keys.view(np.int64), shorts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([_node(t) for t in texts], pa.int64()), *lists], ["doc_id", "node", "keys", "shorts"])

    return run


def _shingled(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks.batched(iter([batch]), "text", _SLICE):
                texts = chunks.encoded(part.column("text"))
                sets = [np.unique(np.array(shingle_hashes(t, words), np.uint64)) for t in texts]
                counts = np.fromiter(map(len, sets), np.int64, len(sets))
                sketches = odd_sketches(np.concatenate([np.empty(0, np.uint64), *sets]), counts)
                columns = [pa.array([_node(t) for t in texts], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(counts.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(np.ascontiguousarray(x)) for x in sketches.T], ["node", "shingles", "size", *_SKETCH])

    return run


def _sets(docs: DataFrame, nodes: DataFrame, met: DataFrame, words: int) -> DataFrame:
    """(node, shingles, size, sketch_0, ...) of the nodes that met, from one document each; from the
    rows without an id for those that have none."""
    wanted = met.select("node").distinct()
    known = nodes.join(wanted, "node", "left_semi")
    schema = "node bigint, shingles array<bigint>, size int, " + ", ".join(f"{c} bigint" for c in _SKETCH)
    sets = docs.join(known.select(F.col("least").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_shingled(words), schema)
    unnamed = docs.where("doc_id IS NULL").mapInArrow(_shingled(words), schema)
    sets = sets.union(unnamed.join(known.where("least IS NULL").select("node"), "node", "left_semi"))
    return sets.dropDuplicates(["node"])


def _meet(short: str, other: str) -> Column:
    """Whether two short fingerprints have a variant in common."""
    return F.bit_count(F.col(short).bitwiseXOR(F.col(other))) <= 2


def _can_be_alike(similarity: float, prefix: str = "pivot_") -> Column:
    """Whether the sketches leave two sets a Jaccard index of at least the similarity: they differ in
    as many items as the sketches in bits, or more."""
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(prefix + c))) for c in _SKETCH), F.lit(0))
    both = F.col("size") + F.col(prefix + "size")
    return (both - apart) / (both + apart) >= similarity


def _of_pivot(*names: str) -> list[Column]:
    return [F.col(n).alias(f"pivot_{n}") for n in names]


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose shingle sets have the wanted Jaccard index, with all their columns."""
    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("others")), "pivot")
    shared = F.size(F.array_intersect("shingles", "others"))
    index = shared / (F.size("shingles") + F.size("others") - shared)
    return both.where(index >= similarity).select(*pairs.columns)


def _undecided(rows: DataFrame) -> DataFrame:
    """Rows of the key sets that hold nodes of several components."""
    several = rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
    return rows.join(several.select("key"), "key", "left_semi")


def _measured(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of key sets with ``size``, the shingles of the node, ``common``, those that any other
    node of these rows has too, and the sketch."""
    own = sets.join(rows.select("node").distinct(), "node", "left_semi")
    holders = own.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("top"))
    alone = holders.where("node = top").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    sizes = own.select("node", "size", *_SKETCH).join(alone, "node", "left")
    return rows.join(sizes.select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"), *_SKETCH), "node")


def _at_most(common: Column, size: Column, other: Column) -> Column:
    """Greatest Jaccard index of a set that shares so many of its items with others at best, and a
    set of the other size."""
    return common / (size + F.greatest(other, common) - common)


def _hopeful(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows of key sets without the nodes that are too unlike every node there.

    A node's own shingles, which nobody else has, bound its similarity to all others: two copies
    that were edited in different places share no more than what neither edit touched. Such a node
    can be in no link of the set, so none is lost, and a large group of copies does not meet it.
    """
    least = rows.groupBy("key").agg(F.min("size").alias("least"))
    bounded = rows.join(least, "key").where(_at_most(F.col("common"), F.col("size"), F.col("least")) >= similarity)
    return bounded.select(*rows.columns)


def _pivots(rows: DataFrame, most: int) -> DataFrame:
    """(key, pivot, pivot_root): in each key set the node with the most links, which brings the
    most others together, and ``most`` nodes from outside its largest component."""
    groups = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("degree", "node")).alias("hub"))
    sets = groups.groupBy("key").agg(
        F.max(F.struct("n", "root")).alias("largest"), F.max_by(F.struct(F.col("hub.node").alias("node"), "root"), "hub").alias("hub")
    )
    outside = rows.join(sets.select("key", F.col("largest.root").alias("largest")), "key").where("root != largest")
    place = F.row_number().over(Window.partitionBy("key").orderBy("node"))
    some = outside.withColumn("place", place).where(F.col("place") <= most).select("key", "node", "root")
    return sets.select("key", "hub.node", "hub.root").union(some).distinct().toDF("key", "pivot", "pivot_root")


def _degrees(links: DataFrame) -> DataFrame:
    return links.select("node").union(links.select("pivot")).groupBy("node").agg(F.count(F.lit(1)).alias("more"))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text", tables: Scratch | None = None) -> DataFrame:
    """(doc_id, component_id): groups of documents linked by a similarity of their word shingles.

    In each set of nodes that share a key, all whose short fingerprints meet that of the least one are
    verified against it. Then those of different components meet, whatever their fingerprints are,
    against more pivots each round. A node leaves a set if its own shingles keep it below the
    similarity to every node there, or as its pivot, when it was verified against every node there
    outside its component. So every pair that shares a key is verified, or in one component, or known
    to be unlike, by its shingles or by their sketches. Texts with the same words are one node; texts
    without words are one group. Null ids and repeated rows as in :func:`near_duplicate_groups`.
    """
    spark = docs.sparkSession
    tables = tables or Scratch(spark)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = source.mapInArrow(_keyed(words), "doc_id bigint, node bigint, keys array<bigint>, shorts array<int>")
    marked = tables.store(marked, "keys", compression="zstd")
    nodes = tables.store(marked.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
    keyed = marked.select("node", "keys", "shorts").dropDuplicates(["node"])
    rows = keyed.select("node", "shorts", F.posexplode("keys").alias("at", "key"))
    rows = rows.select("node", "key", F.col("shorts")[F.col("at")].alias("short"))
    pivots = rows.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top"), F.min_by("short", "node").alias("pivot_short"))
    met = tables.store(rows.join(pivots.where("pivot < top").drop("top"), "key"), "met")
    if met.isEmpty():
        return marked.join(nodes.withColumnRenamed("least", "component_id"), "node").select("doc_id", "component_id")
    sets = tables.store(_sets(source, nodes, met, words), "shingles")  # later rounds meet among these nodes
    seen = sets.select("node", "size", *_SKETCH)
    pairs = met.where((F.col("node") > F.col("pivot")) & _meet("short", "pivot_short")).select("node", "pivot").distinct()
    pairs = pairs.join(seen, "node").join(seen.select(F.col("node").alias("pivot"), *_of_pivot("size", *_SKETCH)), "pivot")
    pairs = tables.store(pairs.where(_can_be_alike(similarity)).select("node", "pivot"), "pairs")
    links = tables.store(_verified(pairs, sets, similarity), "alike")
    roots = components(spark, links, tables)
    known = roots.join(_degrees(links), "node")
    left = met.select("node", "key").join(known, "node", "left")
    left = left.select("node", "key", F.coalesce("root", "node").alias("root"), F.coalesce("more", F.lit(0)).alias("degree"))
    most = PIVOTS
    left = tables.store(_undecided(left), "left")
    left = tables.store(_measured(left, sets), "measured")
    while True:
        left = tables.store(_undecided(_hopeful(left, similarity)), "left")
        if left.isEmpty():
            break
        known = left.select("key", F.col("node").alias("pivot"), *_of_pivot("size", "common", *_SKETCH))
        pivots = tables.store(_pivots(left, most).join(known, ["key", "pivot"]), "pivots")
        shared = F.least("common", "pivot_common")  # the most that the two can have in common
        alike = (shared / (F.col("size") + F.col("pivot_size") - shared) >= similarity) & _can_be_alike(similarity)
        meet = (F.col("key") == F.col("pivot_key")) & (F.col("root") != F.col("pivot_root"))
        met = left.join(pivots.withColumnRenamed("key", "pivot_key"), meet & alike)
        upper = F.col("node") > F.col("pivot")
        ends = [F.when(upper, F.col(a)).otherwise(F.col(b)) for a, b in (("node", "pivot"), ("pivot", "node"), ("root", "pivot_root"), ("pivot_root", "root"))]
        pairs = tables.store(met.select(*[e.alias(n) for e, n in zip(ends, ("node", "pivot", "root", "pivot_root"))]).distinct(), "pairs")
        alike = tables.store(_verified(pairs, sets, similarity), "alike")
        left = left.join(pivots.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti")
        if not alike.isEmpty():
            tops = components(spark, alike.select("root", "pivot_root"), tables).toDF("root", "top")
            moved = roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            alone = tops.join(roots.select(F.col("node").alias("root")), "root", "left_anti").toDF("node", "root")
            roots = tables.store(moved.union(alone), "roots")
            left = left.join(tops, "root", "left").join(_degrees(alike), "node", "left")
            degree = (F.col("degree") + F.coalesce("more", F.lit(0))).alias("degree")
            left = left.select("node", "key", F.coalesce("top", "root").alias("root"), degree, "size", "common", *_SKETCH)
        most *= 8
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.select("node", "root").join(named, "root").select("node", "component_id")
    return marked.select("doc_id", "node").join(known, "node").select("doc_id", "component_id")
