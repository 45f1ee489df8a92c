"""Repeated lines, found through sharded minimal perfect hashes.

1. Each chunk of documents sends its distinct line keys, with the number of its documents that
   have the key and the largest of their ids, to the shards of the key space.
2. A shard builds a minimal perfect hash over its distinct keys; the hash indexes arrays of
   32-bit fingerprints, document counts and largest ids. That is the stored index.
3. The chunks' keys probe the arrays; only keys found in enough documents are answered, and each
   chunk drops their lines from its documents.

No line is joined, and a line that every document has is one entry for each chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thoughtlog.llm import chunks, perfect_hash
from thoughtlog.sources.scratch import Scratch

WHITE = " \t\n\x0b\x0c\r"
_NO_ID = -(2**63)  # below every id

_KEYS = "shard bigint, chunk bigint, keys binary, prints binary, docs binary, top binary"
_KEYS_ARROW = pa.schema([("shard", pa.int64()), ("chunk", pa.int64())] + [(n, pa.binary()) for n in ("keys", "prints", "docs", "top")])
_INDEX = "shard bigint, levels array<binary>, prints binary, docs binary, top binary"
_INDEX_ARROW = pa.schema([("shard", pa.int64()), ("levels", pa.list_(pa.binary()))] + [(n, pa.binary()) for n in ("prints", "docs", "top")])
_ANSWER = "chunk bigint, keys binary, top binary"
_ANSWER_ARROW = pa.schema([("chunk", pa.int64()), ("keys", pa.binary()), ("top", pa.binary())])


def line_key(line: str, min_chars: int) -> bytes | None:
    """Key of a line: stripped, A-Z lower-cased; none if it is too short to count."""
    if len(line) < min_chars:
        return None
    line = line.strip(WHITE)
    return line.encode().lower() if len(line) >= min_chars else None


def _keyed(text: str, min_chars: int) -> list[bytes | None]:
    """128-bit digest of each line's key."""
    keys = [line_key(line, min_chars) for line in text.split("\n")]
    return [None if k is None else xxhash.xxh3_128_digest(k) for k in keys]


def _ids(table: pa.Table) -> np.ndarray:
    return np.array([_NO_ID if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)


def _send(n_shards: int, min_chars: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        digests, owners = [], []
        for owner, text in enumerate(chunks.strings(table.column("text"))):
            own = {d for d in _keyed(text, min_chars) if d is not None}
            digests += own
            owners += [owner] * len(own)
        if not digests:
            return _KEYS_ARROW.empty_table()
        words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        order = np.argsort(words[:, 0], kind="stable")
        hashes, prints, ids = words[order, 0], words[order, 1].astype(np.uint32), _ids(table)[np.array(owners)[order]]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        docs = np.diff(np.concatenate([first, [len(hashes)]])).astype(np.uint32)
        rows = chunks.packed(key[0].as_py(), hashes[first], n_shards, prints=prints[first], docs=docs, top=np.maximum.reduceat(ids, first))
        rows = [row | {n: row[n].tobytes() for n in ("prints", "docs", "top")} for row in rows]
        return pa.Table.from_pylist(rows, _KEYS_ARROW)

    return run


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _build(key: tuple, table: pa.Table) -> pa.Table:
    keys = np.concatenate([chunks.unsqueezed(k) for k in table.column("keys").to_pylist()])
    prints = _joined(table, "prints", "<u4")
    docs, top = _joined(table, "docs", "<u4"), _joined(table, "top", "<i8")
    distinct = np.unique(keys)
    levels = perfect_hash.build(distinct)
    at = perfect_hash.PerfectHash(levels).index(keys)
    out_prints = np.zeros(len(distinct), np.uint32)
    out_prints[at] = prints
    out_docs = np.bincount(at, docs, len(distinct)).astype(np.uint64)
    out_top = np.full(len(distinct), _NO_ID, np.int64)
    np.maximum.at(out_top, at, top)
    row = {"shard": key[0].as_py(), "levels": levels, "prints": out_prints.tobytes(), "docs": out_docs.tobytes(), "top": out_top.tobytes()}
    return pa.Table.from_pylist([row], _INDEX_ARROW)


def _probe(min_docs: int):
    def run(sent: pa.Table, index: pa.Table) -> pa.Table:
        if not sent.num_rows or not index.num_rows:
            return _ANSWER_ARROW.empty_table()
        entry = index.to_pylist()[0]
        table = perfect_hash.PerfectHash(entry["levels"])
        prints, docs, top = (np.frombuffer(entry[n], k) for n, k in (("prints", "<u4"), ("docs", "<u8"), ("top", "<i8")))
        rows = []
        for row in sent.select(["chunk", "keys", "prints"]).to_pylist():
            keys = chunks.unsqueezed(row["keys"])
            at = table.index(keys)
            hit = (prints[at] == np.frombuffer(row["prints"], "<u4")) & (docs[at] >= min_docs)
            if hit.any():
                rows.append({"chunk": row["chunk"], "keys": keys[hit].tobytes(), "top": top[at[hit]].tobytes()})
        return pa.Table.from_pylist(rows, _ANSWER_ARROW)

    return run


def _drop(chunk: str, min_chars: int, digest: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        tops = _joined(answers, "top", "<i8").tolist() if answers.num_rows else []
        sent = b"".join(answers.column("keys").to_pylist()) if answers.num_rows else b""
        last = {sent[8 * i : 8 * i + 8]: top for i, top in enumerate(tops)}
        n_lines, n_dropped, texts, hashed = [], [], [], []
        originals = docs.column("text").to_pylist()
        for original, own in zip(originals, _ids(docs).tolist()):
            whole = original or ""
            lines = whole.split("\n")
            kept = lines
            if last:
                kept = [x for x, key in zip(lines, _keyed(whole, min_chars)) if key is None or last.get(key[:8], own) == own]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
            joined = whole if len(kept) == len(lines) else "\n".join(kept)
            if digest:
                hashed.append(hashlib.sha256(joined.encode()).hexdigest())
            else:
                texts.append(None if original is None else joined)
        counts = {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
        if digest:
            return pa.table({"doc_id": docs.column("doc_id")} | counts | {"kept_sha256": pa.array(hashed, pa.string())})
        own = {n: docs.column(n) for n in docs.column_names if n != chunk and n not in counts}
        return pa.table(own | {"text": pa.array(texts, pa.string())} | counts)

    return run


def line_index(keys: DataFrame) -> DataFrame:
    """(shard, levels, prints, docs, top): a perfect hash and its arrays for each shard."""
    return keys.groupBy("shard").applyInArrow(_build, _INDEX)


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, digest: bool = False, tables: Scratch | None = None) -> DataFrame:
    """Drop lines whose key is found in ``min_docs`` documents or more from all but the largest id.

    Reads ``doc_id`` and ``text``. A line's key is the line without ASCII white space at its ends,
    A-Z lower-cased; keys under ``min_chars`` code points never count. Every row is a document,
    repeated rows too; rows that share the largest id all keep the line; a null id is below every
    other. A null text stays null and has one empty line. All input columns are returned, with
    ``n_lines`` and ``n_dropped`` (which replace columns of those names); with ``digest`` only
    doc_id, these two and ``kept_sha256`` of the kept text.
    """
    tables = tables or Scratch(docs.sparkSession)
    total = chunks.text_bytes(docs)
    n_chunks, n_shards = chunks.parts(total, chunks.CHUNK_BYTES), chunks.parts(total, 4 * chunks.SHARD_BYTES)
    chunk = chunks.unused(docs, "chunk")
    slim = chunks.chunked(docs.select("doc_id", "text"), "chunk", n_chunks, ("doc_id", "text"))
    sent = slim.groupBy("chunk").applyInArrow(_send(n_shards, min_chars), _KEYS)
    sent = tables.store(sent, "line-keys")
    index = tables.store(line_index(sent), "line-index")
    probes = sent.select("shard", "chunk", "keys", "prints").groupBy("shard")
    answers = probes.cogroup(index.groupBy("shard")).applyInArrow(_probe(min_docs), _ANSWER)
    if digest:
        docs = docs.select("doc_id", "text")
        own = [docs.schema["doc_id"]]
    else:
        own = [f for f in docs.schema if f.name not in ("n_lines", "n_dropped")]
    schema = StructType(list(own)).add("n_lines", "long").add("n_dropped", "long")
    if digest:
        schema = schema.add("kept_sha256", "string")
    whole = chunks.chunked(docs, chunk, n_chunks, ("doc_id", "text"))

    return whole.groupBy(chunk).cogroup(answers.groupBy("chunk")).applyInArrow(_drop(chunk, min_chars, digest), schema)
