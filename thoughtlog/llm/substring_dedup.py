"""Repeated word passages, by compaction of a de Bruijn graph of word k-mers.

1. Edges: every run of ``window`` words is an edge between the runs of ``window - 1`` words at its
   ends. Chunks of documents send their distinct edges, by two independent hashes of their words,
   to the shards of the key space and learn which edges occur more than once in the corpus. An edge
   is verified where it stands: both hashes, 80 bits, must be the same at two source coordinates.
2. Inside a document, neighbouring repeated edges make a run. It is cut at its ends and at nodes
   picked by their content, so that equal passages are cut alike; each piece is one row with its
   source coordinate (document, first word), its end nodes and two hashes of its words.
3. Pieces between the same two nodes with equal hashes (128 bits) are one edge of the compacted
   graph. Where a node has one piece in and one out, the pieces follow each other without a branch:
   joins by pointer doubling give each piece its path and its place there.
4. A span of a document is a piece together with its path; the source coordinates say which words
   it covers. The union of a document's spans is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thoughtlog.llm import chunks
from thoughtlog.llm.words import BETWEEN_SPACES, Words, mix, second_hashes, sequence_hashes
from thoughtlog.sources.scratch import Scratch

KEPT_NODES = np.uint64(16)  # one node in so many is kept as an end of pieces

_EDGES = "shard bigint, chunk bigint, keys binary, prints binary, many binary"
_EDGES_ARROW = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("prints", pa.binary()), ("many", pa.binary())])
_ANSWER = "chunk bigint, keys binary, prints binary"
_ANSWER_ARROW = pa.schema([("chunk", pa.int64()), ("keys", pa.binary()), ("prints", pa.binary())])
_PIECES = "chunk bigint, doc bigint, doc_id bigint, start bigint, edges bigint, from_node bigint, to_node bigint, piece bigint, again bigint"
_PIECES_ARROW = pa.schema([(n.split()[0], pa.int64()) for n in _PIECES.split(", ")])


def edge_hashes(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, keys, prints) of all edges: a 64-bit hash and 16 bits of another one."""
    starts, keys = words.windows(window)
    prints = (second_hashes(words.hashes, starts, starts + window) >> np.uint64(48)).astype(np.uint16)
    return starts, keys, prints


def _sorted_edges(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key and print, and the first places of equal pairs in it.

    Only keys that stand next to themselves need their prints in order.
    """
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    mixed = np.flatnonzero(same & (prints[order[1:]] != prints[order[:-1]]))
    if len(mixed):  # different edges with one key
        order = np.lexsort((prints, keys))
        same = keys[order[1:]] == keys[order[:-1]]
    changed = ~same | (prints[order[1:]] != prints[order[:-1]])
    return order, np.flatnonzero(np.concatenate([[True], changed]))


def _send(window: int, n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, _, texts in chunks.unpacked(batch):
                _, keys, prints = edge_hashes(Words(texts, BETWEEN_SPACES), window)
                if not len(keys):
                    continue
                order, first = _sorted_edges(keys, prints)
                many = np.diff(np.concatenate([first, [len(keys)]])) > 1
                rows = chunks.packed(chunk, keys[order[first]], n_shards, prints=prints[order[first]], many=many)
                rows = [row | {"prints": row["prints"].tobytes(), "many": np.packbits(row["many"]).tobytes()} for row in rows]
                yield pa.RecordBatch.from_pylist(rows, _EDGES_ARROW)

    return run


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    """Repeated edges of each chunk: sent by two chunks, or seen twice in one."""
    sent = [chunks.unsqueezed(k) for k in table.column("keys").to_pylist()]
    prints = [np.frombuffer(p, "<u2") for p in table.column("prints").to_pylist()]
    many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)) for m, k in zip(table.column("many").to_pylist(), sent)])
    ends = np.cumsum([len(k) for k in sent]).tolist()
    every, all_prints = np.concatenate(sent), np.concatenate(prints)
    order, first = _sorted_edges(every, all_prints)
    sizes = np.diff(np.concatenate([first, [len(every)]]))
    twice = (sizes > 1) | (np.add.reduceat(many[order].astype(np.int64), first) > 0)
    repeated = np.empty(len(every), bool)
    repeated[order] = np.repeat(twice, sizes)
    rows = []
    for chunk, a, b in zip(table.column("chunk").to_pylist(), [0, *ends[:-1]], ends):
        own = repeated[a:b]
        if own.any():
            rows.append({"chunk": chunk, "keys": chunks.squeezed(every[a:b][own]), "prints": all_prints[a:b][own].tobytes()})
    return pa.Table.from_pylist(rows, _ANSWER_ARROW)


def _among(keys: np.ndarray, prints: np.ndarray, known: np.ndarray, known_prints: np.ndarray) -> np.ndarray:
    """Whether each (key, print) is one of the known pairs, which are sorted by key."""
    found = np.zeros(len(keys), bool)
    if not len(known):
        return found
    at = np.searchsorted(known, keys)
    left = np.flatnonzero(at < len(known))
    while len(left):  # one round, but for different edges with one key
        left = left[known[at[left]] == keys[left]]
        found[left] |= known_prints[at[left]] == prints[left]
        at[left] += 1
        left = left[~found[left] & (at[left] < len(known))]
    return found


def _cut(window: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows or not docs.num_rows:
            return _PIECES_ARROW.empty_table()
        chunk, doc_ids, texts = next(chunks.unpacked(docs))
        words = Words(texts, BETWEEN_SPACES)
        starts, keys, prints = edge_hashes(words, window)
        known = np.concatenate([chunks.unsqueezed(k) for k in answers.column("keys").to_pylist()])
        known_prints = np.concatenate([np.frombuffer(p, "<u2") for p in answers.column("prints").to_pylist()])
        order = np.argsort(known, kind="stable")
        edge = starts[_among(keys, prints, known[order], known_prints[order])]  # first words of repeated edges
        del starts, keys, prints
        if not len(edge):
            return _PIECES_ARROW.empty_table()
        text = np.searchsorted(words.first, edge, "right") - 1
        begins = np.concatenate([[True], (edge[1:] != edge[:-1] + 1) | (text[1:] != text[:-1])])
        node = sequence_hashes(words.hashes, edge, edge + window - 1)
        cut = begins | (mix(node) % KEPT_NODES == 0)
        first = np.flatnonzero(cut)
        start = edge[first]
        last = edge[np.concatenate([first[1:], [len(edge)]]) - 1]
        end = last + window  # one past the last word
        owner = text[first]
        columns = {
            "chunk": np.full(len(first), chunk),
            "doc": owner,
            "start": start - words.first[owner],
            "edges": last - start + 1,
            "from_node": node[first].view(np.int64),
            "to_node": sequence_hashes(words.hashes, end - window + 1, end).view(np.int64),
            "piece": sequence_hashes(words.hashes, start, end).view(np.int64),
            "again": second_hashes(words.hashes, start, end).view(np.int64),
        }
        table = pa.table(columns).append_column("doc_id", doc_ids.cast(pa.int64()).take(pa.array(owner)))
        return table.select(_PIECES_ARROW.names).cast(_PIECES_ARROW)

    return run


def repeated_pieces(packs: DataFrame, window: int, tables: Scratch) -> DataFrame:
    """Pieces of all documents of stored chunks."""
    total = packs.agg(F.sum("size")).first()[0] or 0
    sent = packs.mapInArrow(_send(window, chunks.parts(total, chunks.SHARD_BYTES)), _EDGES)
    answers = sent.groupBy("shard").applyInArrow(_merge, _ANSWER)
    pieces = packs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut(window), _PIECES)
    return tables.store(pieces, "pieces")


def compact(pieces: DataFrame, tables: Scratch) -> DataFrame:
    """(piece, again, path, path_offset, copies): the path without branches each piece lies on.

    ``path`` is the first piece of the path, ``path_offset`` the edges before the piece,
    ``copies`` the source coordinates it was seen at. Equal pieces are one node here, so pieces of
    a passage that many documents share cost one row. Rounds grow with the logarithm of the
    longest path; pieces of a path that runs in a circle keep a path of their own.
    """
    graph = pieces.groupBy("piece", "again").agg(
        F.count(F.lit(1)).alias("copies"), F.first("edges").alias("edges"), F.first("from_node").alias("from_node"), F.first("to_node").alias("to_node")
    )
    graph = tables.store(graph, "graph")
    leaving = graph.groupBy("from_node").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("piece", "again")).alias("after"))
    coming = graph.groupBy("to_node").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("piece", "again", "edges")).alias("before"))
    through = coming.where("n = 1").join(leaving.where("n = 1").select("from_node", "after"), F.col("to_node") == F.col("from_node"))
    links = through.select(F.col("after.piece").alias("piece"), F.col("after.again").alias("again"), F.struct("before.piece", "before.again").alias("up"), F.col("before.edges").alias("back"))
    steps = graph.join(links, ["piece", "again"], "left").select(
        F.struct("piece", "again").alias("at"), "copies", F.col("up"), F.coalesce("back", F.lit(0)).alias("back")
    )
    steps = steps.select("at", "copies", F.coalesce("up", "at").alias("up"), "back", F.col("up").isNull().alias("done"))
    steps = tables.store(steps, "steps")
    rounds = max(1, graph.count().bit_length())
    for _ in range(rounds):
        if steps.where("not done").isEmpty():
            break
        ahead = steps.select(F.col("at").alias("up"), F.col("up").alias("further"), F.col("back").alias("more"), F.col("done").alias("over"))
        moving = steps.where("not done").join(ahead, "up").select("at", "copies", F.col("further").alias("up"), (F.col("back") + F.col("more")).alias("back"), F.col("over").alias("done"))
        steps = tables.store(steps.where("done").unionByName(moving), "steps")
        tables.drop(tables.paths[-2])
    path = F.when(F.col("done"), F.col("up.piece")).otherwise(F.col("at.piece"))
    return steps.select(F.col("at.piece").alias("piece"), F.col("at.again").alias("again"), path.alias("path"), F.when(F.col("done"), F.col("back")).otherwise(0).alias("path_offset"), "copies")


def repeated_spans(packs: DataFrame, window: int, tables: Scratch) -> DataFrame:
    """(chunk, doc, doc_id, start, n_words, path, path_offset, copies) of stored chunks of documents;
    ``doc`` counts the documents of a chunk."""
    pieces = repeated_pieces(packs, window, tables)
    spans = pieces.join(compact(pieces, tables), ["piece", "again"])
    n_words = F.col("edges") + F.lit(window - 1)
    return spans.select("chunk", "doc", "doc_id", "start", n_words.alias("n_words"), "path", "path_offset", "copies")


def _remove(digest: bool):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        cuts: dict[int, list[tuple[int, int]]] = {}
        if spans.num_rows:
            for doc, start, n in zip(*(spans.column(c).to_pylist() for c in ("doc", "start", "n_words"))):
                cuts.setdefault(doc, []).append((start, start + n))
        n_words, n_removed, kept = [], [], []
        _, doc_ids, texts = next(chunks.unpacked(docs))
        for i, text in enumerate(texts):
            words = text.split()
            total = len(words)
            if own := cuts.get(i):
                left, at = [], 0
                for a, b in sorted(own):
                    left += words[at:a] if a > at else []
                    at = max(at, b)
                words = left + words[at:]
            n_words.append(total)
            n_removed.append(total - len(words))
            joined = b" ".join(words)
            kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
        columns = {"doc_id": doc_ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
        return pa.table(columns | {"kept_sha256" if digest else "kept": pa.array(kept, pa.string())})

    return run


def remove_repeated(docs: DataFrame, window: int = 35, digest: bool = False, tables: Scratch | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every document without its repeated words.

    A word is a run of characters other than ASCII white space. A word goes if a run of ``window``
    words of one document covers it whose words also start anywhere else, in the same document
    too; every copy goes. Kept words are joined by one space; with ``digest`` their SHA-256 is
    given as ``kept_sha256`` instead. A null text has no words; repeated rows are documents like
    others, so they repeat each other. Columns other than doc_id and text are not read.
    """
    tables = tables or Scratch(docs.sparkSession)
    packs = tables.store(chunks.pack_documents(docs), "chunks", "none")
    spans = repeated_spans(packs, window, tables)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, " + ("kept_sha256 string" if digest else "kept string")
    wanted = spans.select("chunk", "doc", "start", "n_words").groupBy("chunk")
    return packs.groupBy("chunk").cogroup(wanted).applyInArrow(_remove(digest), schema)
