"""Spelling variants of the words of a corpus, through an index of variable-length grams.

1. Dictionary: the grams of all words, from ``SHORTEST`` to ``LONGEST`` code points, are counted
   by words; those in more than ``rare`` words are *frequent*. A frequent gram never stands for
   itself: it is extended, so the frequent grams are the inner nodes of a pruned tree of grams.
2. Decomposition: the gram at a place of a word (with marks at both ends) is the shortest rare one
   that begins there. It depends on nothing but its own characters.
3. Bounds: an edit at a place affects exactly the grams over that place. For every edit of a word
   the rarest merge is that of the lists of one unaffected gram on either side, the first rare
   gram to the left and the last to the right, at their distance from the word's ends. Where a
   side has no unaffected rare gram it is short, and the whole side takes the gram's place.
4. Merging: words that agree on both sides of an edit meet in one list. Such a list holds at most
   ``rare`` words if a rare gram is in its key; else its words differ in one character only, and
   there are no more of them than letters. No list grows with the corpus.
5. Verification: a pair is kept if it differs by just the edit that brought it together, at the
   first place where the words differ, so that each pair is found once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtlog.sources.scratch import Scratch

LETTERS = r"[A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT = 5, 3
SHORTEST, LONGEST = 2, 8  # code points of a gram, marks counted
LEAST_RARE = 64  # a gram in so many words is rare in any corpus
MAX_GRAMS = 1 << 18  # frequent grams in the dictionary: about 20 MB in each worker

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEYS = "key bigint, gap boolean, low int, high int, word string, n bigint"
_KEYS_ARROW = pa.schema([("key", pa.int64()), ("gap", pa.bool_()), ("low", pa.int32()), ("high", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
_NEAR = "word string, near string, near_n bigint"
_NEAR_ARROW = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
_ROWS = 1 << 16


def runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, word): every run of letters of every whole text, A-Z lower-cased."""
    lowered = F.translate(F.col(text), _UPPER, _LOWER)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))).alias("word"))


def without_character(word: Column, at: Column) -> Column:
    """The word without the code point at a place counted from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def vocabulary(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): how often each word of enough code points occurs, if it does so often enough."""
    counts = words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_count)


def _marked(word: str) -> str:
    return f"^{word}$"


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n: Counter[str] = Counter()
        for word in map(_marked, batch.column("word").to_pylist()):
            for size in range(SHORTEST, min(LONGEST, len(word)) + 1):
                n.update({word[a : a + size] for a in range(len(word) - size + 1)})
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["gram", "n"])


def frequent_grams(vocab: DataFrame, tables: Scratch, most: int = MAX_GRAMS, least_rare: int = LEAST_RARE) -> tuple[frozenset[str], int]:
    """The frequent grams and the number of words up to which a gram is rare.

    That number is such that there cannot be more than ``most`` frequent grams, whatever the words
    are, so the dictionary fits every worker. It decides how long lists are, never what is found.
    """
    grams = vocab.select("word").mapInArrow(_count_grams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = tables.store(grams, "grams")
    places = grams.agg(F.sum("n")).first()[0] or 0
    rare = max(least_rare, -(-places // most))
    return frozenset(r.gram for r in grams.where(F.col("n") > rare).select("gram").collect()), rare


def decompose(word: str, frequent: frozenset[str]) -> list[tuple[int, int]]:
    """(start, end) of the shortest rare gram at each place of a marked word that has one."""
    found = []
    for start in range(len(word) - SHORTEST + 1):
        for end in range(start + SHORTEST, min(start + LONGEST, len(word)) + 1):
            if word[start:end] not in frequent:
                found.append((start, end))
                break
    return found


def edit_keys(word: str, frequent: frozenset[str]) -> Iterator[tuple[bool, int, int, str]]:
    """(gap, low, high, key) for every edit of a marked word: places from low to high share a key.

    A removal at ``i`` leaves out the character there; a gap at ``i`` is the place before it, where
    another word may have one character more.
    """
    size, grams = len(word), decompose(word, frequent)
    head = min(grams, key=lambda g: (g[1], -g[0]), default=(size, size + 1))
    tail = max(grams, default=(-1, -1))
    left = f"{head[0]}:{word[head[0] : head[1]]}"
    right = f"{size - tail[0]}:{word[tail[0] : tail[1]]}"
    for gap in (False, True):
        rest = size - (not gap)
        fixed_from, fixed_to = head[1], tail[0] if gap else tail[0] - 1
        last = size - 1 if gap else size - 2
        place = 1
        while place <= last:
            until = place
            if fixed_from <= place <= fixed_to:
                until = min(last, fixed_to)
            a = left if place >= fixed_from else f"|{word[:place]}"
            b = right if place <= fixed_to else f"|{word[place if gap else place + 1 :]}"
            yield gap, place, until, f"{rest}\0{a}\0{b}"
            place = until + 1


def _emit(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        rows: list[list] = [[] for _ in _KEYS_ARROW]

        def batch_of_rows() -> pa.RecordBatch:
            keys = np.array(rows[0], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c, f.type) for c, f in zip(rows[1:], list(_KEYS_ARROW)[1:]))], schema=_KEYS_ARROW)

        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for gap, low, high, key in edit_keys(_marked(word), frequent):
                    row = (xxhash.xxh3_64_intdigest(key), gap, low, high, word, n)
                    for column, value in zip(rows, row):
                        column.append(value)
                if len(rows[0]) >= _ROWS:
                    yield batch_of_rows()
                    rows[:] = [[] for _ in rows]
        if rows[0]:
            yield batch_of_rows()

    return run


def first_difference(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _linked(x: tuple, y: tuple) -> bool:
    """Whether two entries of a list are a pair whose first difference is an edit of this list."""
    a, b = _marked(x[3]), _marked(y[3])
    if x[0] and y[0] or x[0] and len(a) > len(b) or y[0] and len(b) > len(a):
        return False
    if len(a) < len(b):
        x, y, a, b = y, x, b, a  # a is the longer one, from which a character goes
    at = first_difference(a, b)
    if not max(x[1], y[1]) <= at <= min(x[2], y[2]):
        return False
    if len(a) == len(b):
        return at < len(a) and not x[0] and not y[0] and a[at + 1 :] == b[at + 1 :]
    return not x[0] and y[0] and a[at + 1 :] == b[at:]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the lists of a partition whose rows are sorted by key."""
    rest: pa.Table | None = None

    def pairs(table: pa.Table) -> pa.RecordBatch:
        keys = table.column("key").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(keys)]]))
        many = np.repeat(sizes > 1, sizes)
        sizes = sizes[sizes > 1]
        table = table.select(["gap", "low", "high", "word", "n"]).filter(pa.array(many))
        rows = list(zip(*(c.to_pylist() for c in table.columns)))
        out: list[tuple] = []
        end = 0
        for size in sizes.tolist():
            start, end = end, end + size
            for i in range(start, end):
                for j in range(i + 1, end):
                    if _linked(rows[i], rows[j]):
                        out.append((rows[i][3], rows[j][3], rows[j][4]))
                        out.append((rows[j][3], rows[i][3], rows[i][4]))
        columns = zip(*out) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NEAR_ARROW)], schema=_NEAR_ARROW)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        keys = table.column("key").to_numpy()
        whole = int(np.searchsorted(keys, keys[-1]))  # the last list may go on in the next batch
        if whole:
            yield pairs(table.slice(0, whole))
        rest = table.slice(whole)
    if rest is not None and rest.num_rows:
        yield pairs(rest)


def near_words(vocab: DataFrame, tables: Scratch) -> DataFrame:
    """(word, near, near_n): both directions of every pair one edit apart, each once."""
    frequent, _ = frequent_grams(vocab, tables)
    shared = vocab.sparkSession.sparkContext.broadcast(frequent)
    keys = vocab.select("word", "n").mapInArrow(_emit(shared), _KEYS)
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, _NEAR)


def roots(forms: DataFrame, tables: Scratch) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last by pointer doubling.

    A form is more frequent than its word, so there are no circles, and rounds are few: the
    logarithm of the logarithm of the greatest count.
    """
    steps = tables.store(forms.toDF("word", "root"), "forms")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = tables.store(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        moved = not steps.where("moved").isEmpty()
        steps = steps.select("word", "root")
        if not moved:
            return steps
        tables.drop(tables.paths[-2])


def group_variants(vocab: DataFrame, ratio: int = 2, tables: Scratch | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word of ``vocab`` (word, n).

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's
    form is its near word with the largest n (of equal ones the first in code-point order), if
    that n is at least ``ratio`` times the word's; the root is the last of the forms that follow
    one another, the word itself if there is none. ``word`` is distinct and not null, as
    :func:`vocabulary` makes it; an empty table gives an empty one; other columns are not read.
    A null text has no words, and rows that repeat count as often as they stand there.
    """
    tables = tables or Scratch(vocab.sparkSession)
    vocab = tables.store(vocab.select("word", "n"), "words")
    # among near words the largest n, then the least word: both directions in one minimum
    best = near_words(vocab, tables).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    known = vocab.join(best, "word", "left")
    follows = F.coalesce(-F.col("best.n") >= ratio * F.col("n"), F.lit(False))
    known = known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(follows, F.col("best.word")).alias("form"), F.when(follows, -F.col("best.n")).alias("form_n"),
    )
    known = tables.store(known, "near-words")
    last = roots(known.where("form IS NOT NULL").select("word", "form"), tables)
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
