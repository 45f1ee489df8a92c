"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to a greatest length is learned from a bounded
sample. A byte costs -log2 of its share in the longest context known to the language; if the
context has not seen the byte, the cost of the escape is added (method C: as many escapes as
different bytes) and the next shorter context is asked, down to a uniform byte. Statistics are
frozen after learning, so the costs of all (context, byte) pairs are tables, and the code length
of a text under every language is a sum of looked-up costs. The shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thoughtlog.llm import chunks

ORDER = 3  # longest context in bytes
SAMPLE_DOCS = 400  # expected documents learned from for each language
MAX_LANGUAGES = 1 << 12
UNKNOWN = "und"
_BLOCK = 1 << 20
_SCORED = 1 << 16  # bytes whose costs are held at once: a row of doubles for each


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """(text, lang) of about so many documents of each language, chosen by a hash of the id from
    those with a text and a language that are not held out: one count by language, no shuffle of
    texts. Whole texts are taken."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    share = usable.groupBy("lang").agg((F.lit(per_language) / F.count(F.lit(1))).alias("share"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return usable.join(share, "lang").where(place < F.col("share")).select("text", "lang")


def _count(languages: dict[str, int], order: int):
    """Rows (language, context length, context, byte, n), a context being its bytes from the last
    one back, packed into one number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks.batched(batches, "text", _BLOCK):
            groups: dict[int, list[bytes]] = {}
            for text, lang in zip(chunks.encoded(batch.column("text")), batch.column("lang").to_pylist()):
                groups.setdefault(languages[lang], []).append(b"\0" * order + text)
            for language, texts in groups.items():
                data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
                real = np.concatenate([np.arange(len(t)) >= order for t in texts])
                at = np.flatnonzero(real)
                context = np.zeros(len(at), np.uint64)
                for length in range(order + 1):
                    if length:
                        context |= data[at - length] << np.uint64(8 * (length - 1))
                    keys, n = np.unique(context << np.uint64(8) | data[at], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), language), pa.int32()), pa.array(np.full(len(keys), length), pa.int32()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())],
                        ["language", "length", "key", "n"],
                    )

    return run


class ContextModel:
    """Cost tables of all languages over the union of their context trees."""

    def __init__(self, languages: list[str], order: int, rows: list[tuple[int, int, int, int]]):
        self.languages, self.order = languages, order
        counts: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
        for language, length, key, n in rows:
            counts.setdefault((length, key >> 8), {})[language, key & 255] = n
        seen = sorted({byte for cell in counts.get((0, 0), {}) for byte in cell[1:]} | {0})
        self.classes = np.full(256, len(seen), np.int32)  # bytes never seen are one class
        self.classes[seen] = np.arange(len(seen))
        self.size = size = len(seen) + 1
        nodes = sorted(counts)
        number = {node: i for i, node in enumerate(nodes)}
        self.cost = np.full((len(nodes) * size, len(languages)), 8.0, np.float32)
        self.steps = []
        for length in range(1, order + 1):
            self.steps.append(np.repeat(np.arange(len(nodes), dtype=np.int32), size))
        cost = self.cost.reshape(len(nodes), size, len(languages))
        for i, (length, context) in enumerate(nodes):
            parent = None
            if length:
                shorter = (length - 1, context & ((1 << 8 * (length - 1)) - 1))
                parent = number[shorter]
                oldest = self.classes[context >> 8 * (length - 1)]
                self.steps[length - 1][parent * size + oldest] = i
            row = np.zeros((size, len(languages)))
            for (language, byte), n in counts[length, context].items():
                row[self.classes[byte], language] = n
            total, distinct = row.sum(axis=0), (row > 0).sum(axis=0)
            below = cost[parent] if length else np.full((size, len(languages)), 8.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                coded = -np.log2(row / (total + distinct))
            cost[i] = np.where(row > 0, coded, below + escape)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of every text under every language."""
        sums = np.zeros((len(texts), len(self.languages)))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        data = self.classes[np.frombuffer(b"".join(b"\0" * self.order + t for t in texts), np.uint8)]
        ends = np.cumsum(lengths + self.order)
        for begin in range(self.order, len(data), _SCORED):
            stop = min(len(data), begin + _SCORED)
            node = np.zeros(stop - begin, np.int64)
            for length, step in enumerate(self.steps, 1):
                node = step[node * self.size + data[begin - length : stop - length]]
            costs = self.cost[node * self.size + data[begin:stop]]
            first = np.maximum(ends - lengths, begin) - begin
            last = np.minimum(ends, stop) - begin
            some = np.flatnonzero(first < last)
            if len(some):
                running = np.zeros((len(costs) + 1, costs.shape[1]))
                np.cumsum(costs, axis=0, out=running[1:])
                sums[some] += running[last[some]] - running[first[some]]
        return sums


def learn(docs: DataFrame, order: int = ORDER, per_language: int = SAMPLE_DOCS) -> ContextModel:
    """Learn from a sample whose expected size is a parameter; its counts come to the driver."""
    languages = [r[0] for r in docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang").distinct().sort("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    number = {name: i for i, name in enumerate(languages)}
    counted = sample(docs, per_language).mapInArrow(_count(number, order), "language int, length int, key bigint, n bigint")
    rows = counted.groupBy("language", "length", "key").agg(F.sum("n").alias("n")).collect()
    return ContextModel(languages, order, [tuple(r) for r in rows])


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in chunks.batched(batches, "text", _BLOCK):
            texts = chunks.encoded(batch.column("text"))
            letters = np.array(batch.column("has_letter").to_pylist(), bool)
            names, scores, cost = [], [], np.zeros(len(texts))
            if model.languages:
                bits = model.bits(texts)
                best = bits.argmin(axis=1)
                cost = bits.min(axis=1) / np.maximum([len(t) for t in texts], 1)
                share = 1 / np.exp2(np.clip(bits.min(axis=1)[:, None] - bits, -1000, 0)).sum(axis=1)
            for i, known in enumerate(letters.tolist()):
                known = known and bool(model.languages)
                names.append(model.languages[best[i]] if known else UNKNOWN)
                scores.append(float(share[i]) if known else 0.0)
            own = [n for n in batch.schema.names if n not in ("has_letter", "lang_pred", "score", "bits_per_byte")]
            columns = [batch.column(n) for n in own] + [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(cost, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*own, "lang_pred", "score", "bits_per_byte"])

    return run


def identify(docs: DataFrame, model: ContextModel) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``bits_per_byte`` to every row, where it lies.

    Only the text is looked at, whole. The score is the winner's share of 2**-bits over all
    languages. A text that is null or has no letter is ``und`` with score 0, as is every text if
    no language was learned. Of equal codes the first name wins. The three columns replace
    columns of those names; the others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [f for f in docs.schema if f.name not in ("has_letter", "lang_pred", "score", "bits_per_byte")]
    schema = StructType(list(own)).add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    source = docs.select(*[F.col(f"`{f.name}`") for f in own], F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    return source.mapInArrow(_predict(shared), schema)
