"""Complements of cognitive and action verbs, with the texts of their subtrees."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from thoughtlog.functions.binding import bind
from thoughtlog.functions.text import capitalize, min_words, strip
from thoughtlog.schemas import FINDINGS
from thoughtlog.sources.lexicons import PORTUGUESE, Lexicon

# Parts of speech that count as verbs, and word limits per kind of clause.
VERBS = ("VERB", "AUX")
THOUGHT_WORDS = 2
REACTION_WORDS = 1

_SENTENCE = ["entry_id", "sent_no"]


def _block(number: Column) -> Column:
    return F.shiftright(number.cast("bigint"), 9)


def _by_entry(rows: DataFrame, number: str, value: Column) -> DataFrame:
    """``entry_id, held``: the values of an entry's rows by a number, in maps by blocks of 512
    numbers, so that a look-up stays short in a long entry.

    What meets its entry's row needs no other key than the entry, so a token table in buckets of
    entries is not shuffled for it. Null entries and numbers meet nothing, as in a join.
    """
    known = rows.dropna(subset=["entry_id", number]).groupBy("entry_id", number).agg(value.alias("value"))
    block = F.map_from_entries(F.collect_list(F.struct(F.col(number).cast("bigint"), "value")))
    blocks = known.groupBy("entry_id", _block(F.col(number)).alias("block")).agg(block.alias("of_block"))
    return blocks.groupBy("entry_id").agg(F.map_from_entries(F.collect_list(F.struct("block", "of_block"))).alias("held"))


def _held(number: Column) -> Column:
    """Value of a number in a row of :func:`_by_entry`, null if there is none."""
    return F.try_element_at(F.try_element_at("held", _block(number)), number.cast("bigint"))


def clause_seeds(tokens: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """``entry_id, sent_no, seed, kind, verb_tok, verb_text``: complements of listed verbs.

    Both sides of the parent-child join are filtered first; children look their verbs up among
    those of their entry (:func:`_by_entry`), so only listed verbs are brought together.
    """
    lemma = F.lower("lemma")
    kind = F.when(lemma.isin(sorted(lexicon.cognitive_verbs)), "thought").when(
        lemma.isin(sorted(lexicon.action_verbs)), "reaction"
    )
    verbs = (
        tokens.where(F.col("pos").isin(*VERBS))
        .select("entry_id", "sent_no", "tok_no", F.col("text").alias("verb_text"), kind.alias("kind"))
        .where(F.col("kind").isNotNull())
    )
    deps = sorted(lexicon.thought_deps | lexicon.reaction_deps)
    children = tokens.where(F.col("dep").isin(deps)).select(
        *_SENTENCE, F.col("tok_no").alias("seed"), F.col("head").alias("verb_tok"), "dep"
    )
    wanted = F.when(
        F.col("verb.kind") == "thought", F.col("dep").isin(sorted(lexicon.thought_deps))
    ).otherwise(F.col("dep").isin(sorted(lexicon.reaction_deps)))
    heads = _by_entry(verbs, "tok_no", F.collect_list(F.struct("sent_no", "kind", "verb_text")))
    met = children.join(heads, "entry_id").withColumn("verbs", _held(F.col("verb_tok")))
    return (
        met.where(F.col("verbs").isNotNull())
        .select(*_SENTENCE, "seed", "verb_tok", "dep", F.explode("verbs").alias("verb"))
        .where((F.col("sent_no") == F.col("verb.sent_no")) & wanted)
        .select(*_SENTENCE, "seed", "verb.kind", "verb_tok", "verb.verb_text")
    )


def _word(**tags: Column) -> Column:
    piece = F.concat(F.col("text"), F.coalesce(F.col("ws"), F.lit("")))
    return F.struct("tok_no", "head", piece.alias("piece"), *[value.alias(name) for name, value in tags.items()])


def sentence_rows(tokens: DataFrame, **tags: Column) -> DataFrame:
    """One row per sentence with ``words``: an array of ``(tok_no, head, piece, ...)`` in text
    order, where a piece is a word with its own space and ``tags`` are further fields.

    The token table is read and shuffled once; a sentence is the largest unit put together.
    """
    rows = tokens.select(*_SENTENCE, _word(**tags).alias("word")).groupBy(*_SENTENCE)
    return rows.agg(F.array_sort(F.collect_list("word")).alias("words"))


def sentence_text(words: Column) -> Column:
    """Text of a sentence row."""
    return strip(F.array_join(F.transform(words, lambda word: word["piece"]), ""))


def parents(words: Column) -> Column:
    """Array index of the head of each word, -1 where it is not in the sentence.

    Token numbers mostly have no gaps, so the head is looked for at its distance first.
    """

    def place(head: Column) -> Column:
        guess = head - words[0]["tok_no"]
        at = F.array_position(F.transform(words, lambda w: w["tok_no"]), head) - 1
        hit = F.get(words, guess)["tok_no"] == head
        return F.when((guess >= 0) & hit, guess).otherwise(F.coalesce(at, F.lit(-1))).cast("int")

    return F.transform(words, lambda word: place(word["head"]))


def preorder_of(up: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Order, first and last of a forest given by the parent of each node, -1 for none.

    ``order`` lists the nodes so that all at or below node i are ``order[first[i]:last[i]]``. A
    node that is its own parent has none. Nodes on a cycle of bad input are all below one another.
    Linear in the number of nodes.
    """
    n = len(up)
    below: list[list[int]] = [[] for _ in range(n)]
    roots = []
    for i, u in enumerate(up):
        if u < 0 or u == i:
            roots.append(i)
        else:
            below[u].append(i)
    order: list[int] = []
    first, size = [-1] * n, [1] * n

    def walk(root: int) -> int:
        begin, waiting = len(order), [root]
        while waiting:
            node = waiting.pop()
            if first[node] < 0:
                first[node] = len(order)
                order.append(node)
                waiting.extend(below[node])
        for node in reversed(order[begin + 1 :]):
            size[up[node]] += size[node]
        return begin

    for root in roots:
        walk(root)
    for start in range(n):
        if first[start] >= 0:
            continue
        seen, node = set(), start
        while node not in seen:
            seen.add(node)
            node = up[node]
        cycle = [node]
        while up[cycle[-1]] != node:
            cycle.append(up[cycle[-1]])
        begin = walk(node)
        for i in cycle:
            first[i], size[i] = begin, len(order) - begin
    return order, first, [a + k for a, k in zip(first, size)]


_NODES = ArrayType(IntegerType())


@F.pandas_udf(StructType([StructField(name, _NODES) for name in ("order", "first", "last")]))
def preorder(up: pd.Series) -> pd.DataFrame:
    """Intervals of :func:`preorder_of` for an array of parents; null gives nulls."""
    trees = [(None, None, None) if u is None else preorder_of(list(u)) for u in up]
    return pd.DataFrame(trees, columns=["order", "first", "last"])


def places_below(tree: Column, i: Column) -> Column:
    """Array indexes of the words at or below the one with this index, in text order."""
    first = tree["first"][i]
    return F.array_sort(F.slice(tree["order"], first + 1, tree["last"][i] - first))


def subtree_of(words: Column, tree: Column, i: Column) -> Column:
    """Text of the words at or below the one with this index, stripped."""
    pieces = F.transform(places_below(tree, i), lambda k: words[k]["piece"])
    return strip(F.array_join(pieces, ""))


def _seeded(tokens: DataFrame, seeds: DataFrame) -> DataFrame:
    """Sentence rows that hold given seeds, with their ``tree`` and the ``seeds``' array indexes.

    Tokens of other sentences are left out before sentences are put together.
    """
    wanted = _by_entry(seeds, "sent_no", F.collect_set("seed"))
    held = tokens.join(wanted, "entry_id").select(*_SENTENCE, _word().alias("word"), _held(F.col("sent_no")).alias("toks"))
    rows = held.where(F.col("toks").isNotNull()).groupBy(*_SENTENCE).agg(
        F.array_sort(F.collect_list("word")).alias("words"), F.first("toks").alias("seed_toks")
    )
    places = F.filter(
        F.transform("words", lambda w, i: F.when(F.array_contains("seed_toks", w["tok_no"]), i)),
        lambda i: i.isNotNull(),
    )
    return rows.withColumn("tree", preorder(parents(F.col("words")))).withColumn("seed_places", places)


def subtree_members(tokens: DataFrame, seeds: DataFrame) -> DataFrame:
    """``entry_id, sent_no, seed, tok_no``: every token at or below each seed, once.

    The words of a sentence are put in an order in which every subtree is one interval
    (:func:`preorder_of`); ``seeds`` may be any table of ``entry_id, sent_no, seed``.
    """
    rows = _seeded(tokens, seeds).select(*_SENTENCE, "words", "tree", F.explode("seed_places").alias("s"))
    pairs = rows.select(*_SENTENCE, "words", "s", F.explode(places_below(F.col("tree"), F.col("s"))).alias("i"))
    return pairs.select(
        *_SENTENCE,
        F.col("words")[F.col("s")]["tok_no"].alias("seed"),
        F.col("words")[F.col("i")]["tok_no"].alias("tok_no"),
    )


def subtree_text(tokens: DataFrame, seeds: DataFrame) -> DataFrame:
    """``entry_id, sent_no, seed, subtree``: own words and spaces of the tokens at or below
    each seed, in text order, stripped."""
    words, tree = F.col("words"), F.col("tree")
    texts = F.transform(
        "seed_places",
        lambda s: F.struct(words[s]["tok_no"].alias("seed"), subtree_of(words, tree, s).alias("subtree")),
    )
    return _seeded(tokens, seeds).select(*_SENTENCE, F.inline(texts))


def clause_tags(lexicon: Lexicon) -> dict[str, Column]:
    """Fields of :func:`sentence_rows` that :func:`clause_findings_of` needs."""
    lemma = F.lower("lemma")
    kind = F.when(lemma.isin(sorted(lexicon.cognitive_verbs)), "thought").when(
        lemma.isin(sorted(lexicon.action_verbs)), "reaction"
    )
    return {
        "text": F.col("text"),
        "verb": F.when(F.col("pos").isin(*VERBS), kind),
        "for_thought": F.coalesce(F.col("dep").isin(sorted(lexicon.thought_deps)), F.lit(False)),
        "for_reaction": F.coalesce(F.col("dep").isin(sorted(lexicon.reaction_deps)), F.lit(False)),
    }


def with_trees(rows: DataFrame, kinds: Sequence[str] = ("thought", "reaction")) -> DataFrame:
    """Tagged sentence rows with ``up``, the parent of each word, ``clause``, the kind of clause
    that hangs on a listed verb at each word, and ``tree``, the intervals of the subtrees.

    A sentence without a listed verb has nulls, one without a clause no tree.
    """
    words, up = F.col("words"), F.col("up")

    def kind_of(i: Column) -> Column:
        verb = F.when(up[i] >= 0, words[up[i]]["verb"])
        fits = F.when(verb == "thought", words[i]["for_thought"]).when(
            verb == "reaction", words[i]["for_reaction"]
        )
        return F.when(fits & verb.isin(*kinds), verb)

    verbs = F.exists(words, lambda w: w["verb"].isNotNull())
    rows = rows.withColumn("up", F.when(verbs, parents(words)))
    rows = rows.withColumn("clause", F.when(up.isNotNull(), F.transform(words, lambda _, i: kind_of(i))))
    some = F.exists("clause", lambda k: k.isNotNull())
    return rows.withColumn("tree", preorder(F.when(some, up)))


def clause_findings() -> Column:
    """Array of ``(kind, ord, value)``: the clauses of a row of :func:`with_trees`."""
    words, up, kind, tree = (F.col(c) for c in ("words", "up", "clause", "tree"))

    def clause(s: Column) -> Column:
        verb = words[up[s]]
        order = F.shiftleft(verb["tok_no"].cast("long"), 32) + words[s]["tok_no"]

        def told(subtree: Column) -> Column:
            thought = kind[s] == "thought"
            long_enough = F.when(thought, min_words(subtree, THOUGHT_WORDS)).otherwise(
                min_words(subtree, REACTION_WORDS)
            )
            value = F.when(thought, subtree).otherwise(F.concat_ws(" ", verb["text"], subtree))
            row = F.struct(
                kind[s].alias("kind"), order.alias("ord"), capitalize(value).alias("value")
            )
            return F.when(long_enough, row)

        return bind(subtree_of(words, tree, s), told)

    places = F.filter(F.transform(kind, lambda k, i: F.when(k.isNotNull(), i)), lambda i: i.isNotNull())
    known = F.filter(F.transform(places, clause), lambda row: row.isNotNull())
    return F.when(tree["order"].isNotNull(), known).otherwise(F.array().cast(FINDINGS))


def clauses(
    tokens: DataFrame, lexicon: Lexicon = PORTUGUESE, kind: str | None = None
) -> DataFrame:
    """``entry_id, kind, ord, value``: thoughts and reactions, long enough and capitalised.

    Seeds and subtrees are found inside the sentence row. A reaction starts with its verb,
    which does not count as a word of it.
    """
    kinds = ("thought", "reaction") if kind is None else (kind,)
    rows = with_trees(sentence_rows(tokens, **clause_tags(lexicon)), kinds)
    return rows.select("entry_id", F.inline(clause_findings()))
