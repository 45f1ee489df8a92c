"""Toxicity by weak supervision.

1. Voters: word lists and patterns, each of which is silent or votes "toxic" on a text. Some lists
   are fixed; others are induced from a bounded sample of labelled rows: words that occur, and
   beginnings of words that recur at a rate, far more often in texts with label 1 (by the
   log-likelihood ratio). Induced terms are dealt out in turn, so that no voter has all good ones.
2. A generative label model of the votes: given the hidden label, the votes form a tree, each
   voter's vote depending on one other voter's. Accuracies (vote shares by label) and correlations
   (edges of the tree, by conditional mutual information) are estimated by expectation
   maximization over the vote patterns of *all* texts that may be learned from; known labels are
   held where they are. Spark counts the patterns once and sums the expectations of every round.
3. A linear classifier, logistic regression over terms and votes, is fitted to the posterior
   labels of a bounded sample of texts, chosen by a hash, and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from thoughtlog.llm import chunks
from thoughtlog.sources.scratch import Scratch

LABELLED_ROWS = 20_000  # expected labelled rows, at most, from which terms are induced
FITTED_ROWS = 40_000  # expected texts, at most, on which the classifier is fitted
TERMS = 256  # induced terms of each kind, at most
LISTS = 4  # voters that share the induced terms of a kind
LEAST_RATIO = 30.0  # log-likelihood ratio of an induced term: by chance in one of 20 million
RATE, LEAST_TIMES = 0.0075, 2  # a beginning recurs if it has this share of the words, and so often
BEGINNINGS = range(4, 8)  # letters of a beginning
ROUNDS, TOLERANCE = 30, 1e-4
SURE = 0.98  # posterior of a known label
_BLOCK = 1 << 20

# Common insults and contemptuous words.
INSULTS = ("idiot", "moron", "stupid", "dumb", "fool", "loser", "imbecile", "clown", "jerk", "retard", "bastard", "bitch", "asshole", "coward", "liar")
CONTEMPT = ("pathetic", "worthless", "disgusting", "trash", "scum", "garbage", "filth", "vermin", "useless", "vile", "despise", "ridiculous")
THREATS = ("kill", "murder", "strangle", "shoot", "destroy", "hurt")
FOREIGN_INSULTS = ("dummkopf", "trottel", "arschloch", "abschaum", "scheiße", "idiota", "imbécil", "estúpido", "basura", "mierda", "crétin", "connard", "salaud", "ordure", "imbécile", "merde")

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"(?<!\S)[^\W\d_]+(?:[*@#$0134]+[^\W\d_]+)+(?!\S)")
_YOU = re.compile(r"\byou(?:'re|\s+are)\s+(\w+(?:\s+\w+){0,2})", re.IGNORECASE)
_LOUD = re.compile(r"!{2,}")
_UNMASK = str.maketrans("@$0134", "asoiea")
FIXED = (INSULTS, CONTEMPT, THREATS, FOREIGN_INSULTS)
PATTERNS = ("masked insult", "you are an insult", "shouting", "exclamations")


@dataclass(frozen=True)
class Voters:
    """Words and beginnings of words, in the order of their strength."""

    words: tuple[str, ...]
    beginnings: tuple[str, ...]

    def __post_init__(self):
        fixed = {w: i for i, words in enumerate(FIXED) for w in words}
        object.__setattr__(self, "_fixed", fixed)
        object.__setattr__(self, "_word", {w: i for i, w in enumerate(self.words)})
        object.__setattr__(self, "_beginning", {b: i for i, b in enumerate(self.beginnings)})

    @property
    def n_votes(self) -> int:
        return len(FIXED) + len(PATTERNS) + 2 * LISTS

    @property
    def n_features(self) -> int:
        return self.n_votes + len(self.words) + len(self.beginnings)

    def active(self, text: str) -> list[int]:
        """Features of a text in order: votes first, then words and beginnings."""
        words = Counter(w.lower() for w in _WORD.findall(text))
        total = sum(words.values())
        votes = {self._fixed[w] for w in words.keys() & self._fixed.keys()}
        for at, voted in enumerate(self._patterns(text, words, total), len(FIXED)):
            if voted:
                votes.add(at)
        own = [self._word[w] for w in words.keys() & self._word.keys()]
        often: Counter[int] = Counter()
        if self._beginning:
            for word, n in words.items():
                for size in BEGINNINGS:
                    if (at := self._beginning.get(word[:size])) is not None and len(word) >= size:
                        often[at] += n
        recurring = [at for at, n in often.items() if recurs(n, total)]
        base = len(FIXED) + len(PATTERNS)
        votes |= {base + at % LISTS for at in own} | {base + LISTS + at % LISTS for at in recurring}
        terms = [self.n_votes + at for at in own] + [self.n_votes + len(self.words) + at for at in recurring]
        return sorted(votes) + sorted(terms)

    def _patterns(self, text: str, words: Counter, total: int) -> tuple[bool, ...]:
        """Votes of the patterns, in the order of their names."""

        def bad(word: str) -> bool:
            word = word.lower()
            return word in self._fixed or word in self._word

        masked = any(bad(m.translate(_UNMASK)) or bad(re.sub(r"[*@#$]", "", m)) for m in _MASKED.findall(text))
        you = any(bad(w) for m in _YOU.findall(text) for w in m.split())
        upper = sum(w.isupper() and len(w) > 1 for w in _WORD.findall(text)) if text[:1] else 0
        return masked, you, total > 0 and upper > 0.3 * total, len(_LOUD.findall(text)) > 0.1 * max(total, 1)


def recurs(times: int, total: int) -> bool:
    return times >= LEAST_TIMES and times >= RATE * total


def _share(limit: int, count: Column) -> Column:
    return F.lit(limit) / F.greatest(count, F.lit(limit))


def _picked(key: Column, salt: str, share: float) -> Column:
    """A share of the rows, by a hash of their key."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(salt)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def known_labels(labels: DataFrame, learnable: Column, limit: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, gold) of at most about ``limit`` rows with an id and a label, chosen by a hash."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learnable)
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("gold"))
    share = min(1.0, limit / max(1, known.count()))
    return known.where(_picked(F.col("doc_id"), "labelled", share))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks.batched(batches, "text", _BLOCK):
        seen: Counter[tuple[str, str, int]] = Counter()
        for text, gold in zip(chunks.strings(batch.column("text")), batch.column("gold").to_pylist()):
            words = Counter(w.lower() for w in _WORD.findall(text))
            total = sum(words.values())
            seen.update(("word", w, gold) for w in words)
            often: Counter[str] = Counter()
            for word, n in words.items():
                for size in BEGINNINGS:
                    if len(word) >= size:
                        often[word[:size]] += n
            seen.update(("beginning", b, gold) for b, n in often.items() if recurs(n, total))
        kinds, terms, golds = zip(*seen) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(terms, pa.string()), pa.array(golds, pa.int32()), pa.array(seen.values(), pa.int64())], ["kind", "term", "gold", "n"]
        )


def log_likelihood_ratio(a: Column, b: Column, toxic: int, clean: int) -> Column:
    """G-squared of a term in a of so many toxic and b of so many clean texts."""
    total = float(toxic + clean)

    def part(n: Column, of: int) -> Column:
        with_term, without = (a + b) * (of / total), (F.lit(total) - a - b) * (of / total)
        rest = F.lit(float(of)) - n
        return F.when(n > 0, n * F.log(n / with_term)).otherwise(0.0) + F.when(rest > 0, rest * F.log(rest / without)).otherwise(0.0)

    return 2 * (part(a.cast("double"), toxic) + part(b.cast("double"), clean))


def induce(docs: DataFrame, known: DataFrame) -> Voters:
    """Voters with the terms that mark label 1 among labelled texts; equal texts count once."""
    rows = docs.select("doc_id", "text").join(known, "doc_id").select("text", "gold").dropDuplicates(["text"])
    counted = rows.mapInArrow(_count_terms, "kind string, term string, gold int, n bigint")
    sizes = {r.gold: r.n for r in rows.groupBy("gold").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Voters((), ())
    counts = counted.groupBy("kind", "term").agg(*[F.sum(F.when(F.col("gold") == y, F.col("n")).otherwise(0)).alias(name) for y, name in ((1, "a"), (0, "b"))])
    scored = counts.where(F.col("a") * clean > F.col("b") * toxic).withColumn("ratio", log_likelihood_ratio(F.col("a"), F.col("b"), toxic, clean))
    scored = scored.where(F.col("ratio") >= LEAST_RATIO)
    best = {kind: scored.where(F.col("kind") == kind).orderBy(F.desc("ratio"), "term").limit(TERMS).collect() for kind in ("word", "beginning")}
    return Voters(tuple(r.term for r in best["word"]), tuple(r.term for r in best["beginning"]))


def _vote(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = shared.value
        for batch in chunks.batched(batches, "text", _BLOCK):
            active = [voters.active(text) for text in chunks.strings(batch.column("text"))]
            votes = [sum(1 << at for at in own if at < voters.n_votes) for own in active]
            columns = [batch.column(n) for n in batch.schema.names if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(votes, pa.int64()), pa.array(active, pa.list_(pa.int32()))], [*names, "votes", "active"])

    return run


def voted(docs: DataFrame, voters: Voters) -> DataFrame:
    """The rows with ``votes`` (bits) and ``active`` (features) instead of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    schema = StructType([f for f in docs.schema if f.name != "text"]).add("votes", "long").add("active", ArrayType(IntegerType()))
    return docs.mapInArrow(_vote(shared), schema)


def bits(votes: Sequence[int], n: int) -> np.ndarray:
    return (np.array(votes, np.int64).reshape(-1, 1) >> np.arange(n)) & 1


class LabelModel:
    """Hidden label, and votes in a tree given the label.

    Built from expected counts: ``sums[y]`` is the weighted sum, over texts of label y, of the outer
    product of (1, votes) with itself. Where a voter has hardly been seen with its neighbour in the
    tree, chances fall back on those of independent votes.
    """

    def __init__(self, sums: np.ndarray):
        total, n = sums[:, 0, 0], sums.shape[1] - 1
        self.n_votes = n
        self.prior = (total[1] + 1) / (total.sum() + 2)
        self.accuracy = (sums[:, 0, 1:] + 0.5) / (total[:, None] + 1)  # share of votes by label
        both = sums[:, 1:, 1:]
        ones = sums[:, 0, 1:]
        # cells[y, i, j, a, b]: expected count of vote i = a and vote j = b
        cells = np.empty((2, n, n, 2, 2))
        cells[..., 1, 1] = both
        cells[..., 1, 0] = ones[:, :, None] - both
        cells[..., 0, 1] = ones[:, None, :] - both
        cells[..., 0, 0] = total[:, None, None] - ones[:, :, None] - ones[:, None, :] + both
        alone = np.stack([1 - self.accuracy, self.accuracy], axis=2)  # chance of each vote by label
        cells = np.maximum(cells, 0) + alone[:, :, None, :, None] * alone[:, None, :, None, :]
        joint = cells / cells.sum(axis=(3, 4), keepdims=True)
        apart = joint.sum(axis=4, keepdims=True) * joint.sum(axis=3, keepdims=True)
        weight = (total + 1) / (total + 1).sum()
        self.information = (weight[:, None, None] * (joint * np.log(joint / apart)).sum(axis=(3, 4))).sum(axis=0)
        np.fill_diagonal(self.information, 0)
        # the tree with the most information, grown from the first voter
        self.parent = np.full(n, -1)
        reach, link, left = self.information[0].copy(), np.zeros(n, int), set(range(1, n))
        while left:
            j = max(left, key=lambda k: (reach[k], -k))
            self.parent[j] = link[j]
            left.remove(j)
            better = self.information[j] > reach
            reach, link = np.where(better, self.information[j], reach), np.where(better, j, link)
        # log chances: chance[y, j, vote of the parent, vote of j]
        self.chance = np.empty((2, n, 2, 2))
        for j, p in enumerate(self.parent):
            pair = cells[:, p, j] if p >= 0 else np.repeat(alone[:, j, None, :], 2, axis=1)
            self.chance[:, j] = np.log(pair / pair.sum(axis=2, keepdims=True))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for rows of votes."""
        score = np.array([[np.log(1 - self.prior)], [np.log(self.prior)]])
        for j, p in enumerate(self.parent):
            given = x[:, p] if p >= 0 else 0
            score = score + self.chance[:, j, given, x[:, j]]
        return 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))


def _expect(shared, n: int, unknown: float):
    """Sums of outer products by label over vote patterns (votes, gold, n); texts of unknown label
    have the given weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LabelModel | None = shared.value
        sums = np.zeros((2, n + 1, n + 1))
        for batch in batches:
            x = bits(batch.column("votes").to_pylist(), n)
            gold = np.array([-1 if g is None else g for g in batch.column("gold").to_pylist()])
            # before the first round silence says clean, and any vote says toxic
            guess = np.where(x.any(axis=1), 0.9, 0.05) if model is None else model.posterior(x)
            q = np.where(gold < 0, guess, np.where(gold > 0, SURE, 1 - SURE))
            times = np.array(batch.column("n").to_pylist(), float) * np.where(gold < 0, unknown, 1)
            wide = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            for y, weight in ((0, (1 - q) * times), (1, q * times)):
                sums[y] += (wide * weight[:, None]).T @ wide
        place = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums.ravel())], ["place", "sum"])

    return run


def learn_labels(patterns: DataFrame, n_votes: int) -> LabelModel:
    """The label model of vote patterns (votes, gold, n): gold is null where it is unknown.

    Texts of unknown label together weigh no more than those of known label, if there are any of
    both labels; else a text with few votes would be drawn to the many without any. Every round
    is one pass over the patterns, of which there are never more than texts or than subsets of the
    voters; (1 + voters)**2 sums of each label come to the driver.
    """
    spark = patterns.sparkSession
    by_gold = {r.gold: r.n for r in patterns.groupBy("gold").agg(F.sum("n").alias("n")).collect()}
    both = bool(by_gold.get(0) and by_gold.get(1))
    unknown = min(1.0, (by_gold.get(0, 0) + by_gold.get(1, 0)) / max(1, by_gold.get(None, 0))) if both else 1.0

    def sums(rows: DataFrame, model: LabelModel | None) -> np.ndarray:
        shared = spark.sparkContext.broadcast(model)
        parts = rows.select("votes", "gold", "n").mapInArrow(_expect(shared, n_votes, unknown), "place bigint, sum double")
        out = np.zeros(2 * (n_votes + 1) ** 2)
        for r in parts.groupBy("place").agg(F.sum("sum").alias("sum")).collect():
            out[r.place] = r.sum
        shared.unpersist()
        return out.reshape(2, n_votes + 1, n_votes + 1)

    model = LabelModel(sums(patterns.where("gold IS NOT NULL") if both else patterns, None))
    for _ in range(ROUNDS):
        last, model = model, LabelModel(sums(patterns, model))
        if max(np.abs(model.accuracy - last.accuracy).max(), abs(model.prior - last.prior)) < TOLERANCE:
            break
    return model


def _soft(shared, n_features: int):
    """Dense features and both labels, weighted by the posterior."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            q = np.clip(model.posterior(bits(batch.column("votes").to_pylist(), model.n_votes)), 1e-3, 1 - 1e-3)
            x = np.zeros((len(q), n_features))
            for row, active in zip(x, batch.column("active").to_pylist()):
                row[active] = 1
            features = [row.tolist() for row in x]
            yield pa.RecordBatch.from_arrays(
                [pa.array(features * 2, pa.list_(pa.float64())), pa.array(np.repeat([1.0, 0.0], len(q))), pa.array(np.concatenate([q, 1 - q]))], ["features", "label", "weight"]
            )

    return run


def fit(rows: DataFrame, model: LabelModel, n_features: int) -> tuple[list[float], float]:
    """Coefficients and intercept of the linear classifier on posterior labels."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    soft = rows.select("votes", "active").mapInArrow(_soft(shared, n_features), "features array<double>, label double, weight double")
    if soft.isEmpty():
        return [0.0] * n_features, float(np.log(model.prior / (1 - model.prior)))
    fitted = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1e-4, maxIter=60, standardization=False).fit(soft.withColumn("features", array_to_vector("features")))
    return [float(c) for c in fitted.coefficients], float(fitted.intercept)


def score(docs: DataFrame, labels: DataFrame, learnable: Column, tables: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` without their text, with ``score``: the chance of label 1.

    ``labels`` has doc_id and toxic (1 or 0); ``learnable`` is a condition on doc_id, which must
    hold for rows to be learned from, labels and texts alike. Texts are read whole; neither labels
    nor other columns are part of a score. Labels that are null or without an id are left out, of
    several labels of one id the largest holds. A null or empty text has no word and gets the score
    of silence; repeated rows are rows; with no labels the fixed lists alone start the label model;
    an empty table gives an empty one. Columns called score, votes or active are replaced.
    """
    tables = tables or Scratch(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "votes", "active", "gold")])
    known = tables.store(known_labels(labels, learnable), "labels")
    voters = induce(docs.where(learnable), known)
    rows = tables.store(voted(docs, voters), "votes")
    learned = rows.where(learnable).select(F.col("doc_id").cast("bigint").alias("doc_id"), "votes")
    patterns = learned.join(known, "doc_id", "left").groupBy("votes", "gold").agg(F.count(F.lit(1)).alias("n"))
    model = learn_labels(tables.store(patterns, "patterns"), voters.n_votes)
    sample = rows.where(learnable)
    share = min(1.0, FITTED_ROWS / max(1, sample.count()))
    weights, intercept = fit(sample.where(_picked(F.col("doc_id"), "fitted", share)), model, voters.n_features)
    table = F.array(*[F.lit(w) for w in weights])
    total = F.aggregate("active", F.lit(intercept), lambda s, at: s + F.get(table, at))
    return rows.withColumn("score", 1 / (1 + F.exp(-total))).drop("votes", "active")
