"""Everything that records are made of, from one reading of the token table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thoughtlog.functions.text import capitalize, min_words, strip
from thoughtlog.operators.clauses import REACTION_WORDS, THOUGHT_WORDS, VERBS, preorder_of
from thoughtlog.operators.keywords import is_keyword
from thoughtlog.operators.membership import member
from thoughtlog.operators.phrases import phrase_places
from thoughtlog.operators.tokens import PERSON_PLACE
from thoughtlog.sources.lexicons import PORTUGUESE, Lexicon
from thoughtlog.sources.sizes import literal_table

# What a token is to its sentence, as bits of one number.
THOUGHT_VERB, REACTION_VERB, FOR_THOUGHT, FOR_REACTION, NOUN, NAMED = (1 << i for i in range(6))
# Token numbers are ints; a missing one is below all of them.
_NO_TOKEN, _SENTENCE = -(1 << 32), 1 << 34


def _tags(lexicon: Lexicon) -> Column:
    lemma, verb = F.lower("lemma"), F.col("pos").isin(*VERBS)
    cognitive = member(lemma, lexicon.cognitive_verbs)
    flags = {
        THOUGHT_VERB: verb & cognitive,
        REACTION_VERB: verb & ~cognitive & member(lemma, lexicon.action_verbs),
        FOR_THOUGHT: F.col("dep").isin(sorted(lexicon.thought_deps)),
        FOR_REACTION: F.col("dep").isin(sorted(lexicon.reaction_deps)),
        NOUN: member(lemma, lexicon.context_nouns),
        NAMED: F.col("ent_label").isin(*PERSON_PLACE),
    }
    tags = F.lit(0)
    for bit, flag in flags.items():
        tags = tags.bitwiseOR(F.when(flag, bit).otherwise(0))
    return tags


def sentence_findings(places: list[tuple[int, str, int, int, str]]) -> Callable:
    """Findings of whole sentences that lie one after another in batches of tokens, in text order.

    A sentence begins with the word of place 1; the last one of a batch waits for the next batch.
    Pieces of text are put together only for the few sentences that have a finding.
    """
    order = sorted(range(len(places)), key=lambda i: places[i][4])
    names = sorted({p[4] for p in places})
    which = np.searchsorted(np.array([places[i][4] for i in order], object), np.array(names, object)) if names else np.zeros(0, np.int64)
    first_of = np.concatenate([which, [len(order)]]).astype(np.int64)
    phrase, n_lemmas, place_of = (np.array([places[i][k] for i in order], np.int64) for k in (0, 2, 3))
    category = {p[0]: p[1] for p in places}
    label = {p[0]: f"{p[2]}/{p[0]}/{p[1]}" for p in places}
    pair = pa.struct([("ord", pa.int64()), ("value", pa.string())])

    def numbers(column: pa.Array, missing: int) -> np.ndarray:
        return column.cast(pa.int64()).fill_null(missing).to_numpy(False)

    def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        if not table.num_rows:
            return
        entry, piece, text, ent_id, keyword = (
            table.column(c).chunk(0) for c in ("entry_id", "piece", "verb_text", "ent_id", "keyword")
        )
        tok, head = (numbers(table.column(c).chunk(0), _NO_TOKEN) for c in ("tok_no", "head"))
        tags = numbers(table.column("tags").chunk(0), 0)
        begin = np.flatnonzero(numbers(table.column("place").chunk(0), 0) == 1)
        end = np.concatenate([begin[1:], [len(tok)]])
        sent = np.repeat(np.arange(len(begin)), end - begin)
        key = sent * _SENTENCE + tok - _NO_TOKEN  # ascends with the rows
        rows: list[tuple] = []  # row, kind, ord, value, verb

        def ordinal(i: int) -> int | None:
            return None if tok[i] == _NO_TOKEN else int(tok[i])

        def joined(at: list[int]) -> str:
            return "".join(x for x in piece.take(pa.array(at, pa.int64())).to_pylist() if x is not None)

        # situations and triggers
        named = np.flatnonzero(tags & NAMED)
        for s in np.unique(sent[np.flatnonzero(tags & (NOUN | NAMED))]).tolist():
            a, b = int(begin[s]), int(end[s])
            rows.append((a, "situation", None, "".join(x for x in piece.slice(a, b - a).to_pylist() if x is not None), None))
        entities: dict[tuple, list[int]] = {}
        for i, s, e in zip(named.tolist(), sent[named].tolist(), ent_id.take(pa.array(named)).to_pylist()):
            entities.setdefault((s, e), []).append(i)
        for at in entities.values():
            rows.append((at[0], "trigger", ordinal(at[0]), joined(at), None))

        # clauses: parents by distance, else by number
        spoken = np.zeros(len(begin), bool)
        spoken[sent[np.flatnonzero(tags & (THOUGHT_VERB | REACTION_VERB))]] = True
        at = np.flatnonzero(spoken[sent] & (head != _NO_TOKEN))
        opening = begin[sent[at]]
        guess = opening + head[at] - tok[opening]
        inside = (tok[opening] != _NO_TOKEN) & (guess >= opening) & (guess < end[sent[at]])
        near = np.where(inside, guess, 0)
        hit = inside & (tok[near] == head[at])
        wanted = sent[at] * _SENTENCE + head[at] - _NO_TOKEN
        far = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        up = np.full(len(tok), -1, np.int64)
        up[at] = np.where(hit, near, np.where(key[far] == wanted, far, -1))
        over = tags[up]
        fits = ((over & THOUGHT_VERB) != 0) & ((tags & FOR_THOUGHT) != 0) | ((over & REACTION_VERB) != 0) & ((tags & FOR_REACTION) != 0)
        seeds = np.flatnonzero((up >= 0) & fits)
        breaks = np.flatnonzero(np.diff(sent[seeds])) + 1
        for group in np.split(seeds, breaks) if len(seeds) else ():
            a, b = int(begin[sent[group[0]]]), int(end[sent[group[0]]])
            pieces = [x or "" for x in piece.slice(a, b - a).to_pylist()]
            tree, first, last = preorder_of(np.where(up[a:b] >= 0, up[a:b] - a, -1).tolist())
            for i in group.tolist():
                verb = int(up[i])
                below = "".join([pieces[k] for k in sorted(tree[first[i - a] : last[i - a]])])
                where = None if None in (ordinal(verb), ordinal(i)) else (ordinal(verb) << 32) + ordinal(i)
                if tags[verb] & THOUGHT_VERB:
                    rows.append((i, "thought", where, below, None))
                else:
                    rows.append((i, "reaction", where, below, text[verb].as_py()))

        # phrases: votes for starts, whole or cut off by the sentence's borders
        lemma_no = table.column("lemma_no").chunk(0)
        at = np.flatnonzero(lemma_no.is_valid().to_numpy(False))
        lemma = numbers(lemma_no, 0)[at]
        times = first_of[lemma + 1] - first_of[lemma]
        row = np.repeat(at, times)
        vote = np.repeat(first_of[lemma] - (np.cumsum(times) - times), times) + np.arange(len(row))
        start = np.where(tok[row] == _NO_TOKEN, _NO_TOKEN, tok[row] - place_of[vote])
        sort = np.lexsort((start, phrase[vote], sent[row]))
        row, vote, start = row[sort], vote[sort], start[sort]
        keys = np.stack([sent[row], phrase[vote], start])
        heads = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if len(row) else row
        n = np.diff(np.concatenate([heads, [len(row)]]))
        row, vote, start = row[heads], vote[heads], start[heads]
        low = sent[row] * _SENTENCE + start - _NO_TOKEN
        within = np.searchsorted(key, low + n_lemmas[vote]) - np.searchsorted(key, low)
        within[start == _NO_TOKEN] = 0
        whole = n == n_lemmas[vote]
        for j in np.flatnonzero(whole | (n == within)).tolist():
            number, ordered = int(phrase[vote[j]]), None if start[j] == _NO_TOKEN else int(start[j])
            if whole[j]:
                rows.append((int(row[j]), "emotion", ordered, category[number], None))
            else:
                rows += [(int(row[j]), "part", ordered, label[number], None)] * int(n[j])

        schema = pa.schema(
            [("entry_id", entry.type), ("kind", pa.string()), ("ord", pa.int64()), ("value", pa.string()), ("verb", pa.string()), ("words", pa.list_(pair))]
        )
        if rows:
            at, kinds, ords, values, verbs = zip(*rows)
            # a sentence is ordered by its own number
            by_sentence = table.column("sent_no").chunk(0).cast(pa.int64()).take(pa.array(at, pa.int64())).to_pylist()
            ords = [s if k == "situation" else o for k, o, s in zip(kinds, ords, by_sentence)]
            arrays = [entry.take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(ords, pa.int64()), pa.array(values, pa.string()), pa.array(verbs, pa.string()), pa.nulls(len(at), pa.list_(pair))]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

        # keywords: one row for each entry that lies here
        at = np.flatnonzero(keyword.is_valid().to_numpy(False))
        if len(at):
            whose = entry.dictionary_encode(null_encoding="encode").indices.to_numpy(False)[at]
            heads = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
            here = pa.array(at)
            ords = table.column("tok_no").chunk(0).cast(pa.int64()).take(here)
            words = pa.StructArray.from_arrays([ords, keyword.take(here)], fields=list(pair))
            lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(at)), pa.int32()), words)
            none = pa.nulls(len(heads), pa.string())
            arrays = [entry.take(pa.array(at[heads])), pa.array(["keyword"] * len(heads)), pa.nulls(len(heads), pa.int64()), none, none, lists]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            begins = np.flatnonzero(batch.column("place").to_numpy(False) == 1)
            if len(begins):
                cut = int(begins[-1])
                yield from found([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield from found(held)

    return run


def findings(tokens: DataFrame, lexicon: Lexicon = PORTUGUESE, keywords: bool = False) -> DataFrame:
    """``entry_id, kind, ord, value, words``: everything the records are made of, a row each; the
    keywords of an entry come in a few rows, as arrays ``words`` of ``(ord, value)``.

    The tokens are read once and brought into text order by sentence once, without a shuffle if they
    lie by entry already. Phrases may cross sentences: what a sentence has of one that its borders cut
    off comes as ``part`` rows, each with the phrase's length, number and category.
    """
    places = phrase_places(lexicon)
    numbered = list({lemma: i for i, lemma in enumerate(sorted({p[4] for p in places}))}.items())
    known = literal_table(tokens.sparkSession, numbered, _lemma=pa.string(), lemma_no=pa.int32())
    tags = _tags(lexicon)
    keyword = F.when(is_keyword(lexicon), F.lower("lemma")) if keywords else F.lit(None).cast("string")
    tagged = tokens.join(known, F.col("lemma") == F.col("_lemma"), "left").select(
        "entry_id",
        "sent_no",
        "tok_no",
        "head",
        F.concat(F.col("text"), F.coalesce(F.col("ws"), F.lit(""))).alias("piece"),
        F.when(tags.bitwiseAND(THOUGHT_VERB | REACTION_VERB) > 0, F.col("text")).alias("verb_text"),
        tags.alias("tags"),
        "ent_id",
        keyword.alias("keyword"),
        "lemma_no",
    )
    sentence = Window.partitionBy("entry_id", "sent_no").orderBy("tok_no", "head", "piece")
    placed = tagged.withColumn("place", F.row_number().over(sentence))
    entry = tokens.schema["entry_id"].dataType.simpleString()
    raw = placed.mapInArrow(
        sentence_findings(places),
        f"entry_id {entry}, kind string, ord bigint, value string, verb string, words array<struct<ord:bigint,value:string>>",
    )
    kind, bare = F.col("kind"), F.col("value")
    texts = raw.withColumn("value", F.when(kind.isin("situation", "trigger", "thought", "reaction"), strip(bare)).otherwise(bare))
    long_enough = F.when(kind == "thought", min_words(bare, THOUGHT_WORDS)).when(kind == "reaction", min_words(bare, REACTION_WORDS)).otherwise(True)
    told = F.when(kind == "thought", capitalize(bare)).when(kind == "reaction", capitalize(F.concat_ws(" ", "verb", "value"))).otherwise(bare)
    return texts.where(long_enough).select("entry_id", "kind", "ord", told.alias("value"), "words")
