from __future__ import annotations

import random
import time
from dataclasses import replace

from thoughtlog.operators import clauses as oc
from thoughtlog.operators.records import reactions, thoughts
from thoughtlog.schemas import TOKEN
from thoughtlog.sources.lexicons import PORTUGUESE

THINK = (
    "Eu/eu/PRON/nsubj/2 acho/achar/VERB/root/0 que/que/SCONJ/mark/5 ele/ele/PRON/nsubj/5 "
    "vai/ir/VERB/ccomp/2 embora/embora/ADV/advmod/5 _././PUNCT/punct/2"
)


def test_thought_and_reaction_rules(make_tokens):
    tokens = make_tokens(
        {
            1: [THINK, THINK],
            2: ["Acho/achar/VERB/root/0 que/que/SCONJ/mark/3 sim/sim/ADV/ccomp/1"],
            3: [
                "Sei/saber/AUX/root/0 que/que/SCONJ/mark/4 João/João/PROPN/nsubj/4@PER Veio/vir/VERB/ccomp/1",
            ],
            4: [
                "Saí/sair/VERB/root/0 dali/dali/ADV/obl/1",
                "Saí/sair/VERB/root/0 de/de/ADP/case/3 casa/casa/NOUN/obl/1",
                "Fiz/fazer/VERB/root/0 o/o/DET/det/3 jantar/jantar/NOUN/obj/1",
                "Parei/parar/NOUN/root/0 de/de/ADP/case/3 comer/comer/VERB/xcomp/1",
            ],
        }
    )
    assert {r.entry_id: r.thoughts for r in thoughts(tokens).collect()} == {
        1: "Que ele vai embora",
        3: "Que joão veio",
    }
    assert {r.entry_id: r.reactions for r in reactions(tokens).collect()} == {4: "Saí de casa"}
    with_objects = replace(PORTUGUESE, reaction_deps=PORTUGUESE.reaction_deps | {"obj"})
    assert {r.entry_id: r.reactions for r in reactions(tokens, with_objects).collect()} == {
        4: "Saí de casa | Fiz o jantar"
    }


def test_order_and_nesting(make_tokens):
    sentence = (
        "penso/pensar/VERB/root/0 que/que/SCONJ/mark/4 ela/ela/PRON/nsubj/4 sabe/saber/VERB/ccomp/1 "
        "que/que/SCONJ/mark/8 eu/eu/PRON/nsubj/8 não/não/ADV/advmod/8 vou/ir/AUX/ccomp/4 "
        "sair/sair/VERB/xcomp/8 hoje/hoje/ADV/advmod/9"
    )
    tokens = make_tokens({1: [sentence]})
    assert thoughts(tokens).first().thoughts == (
        "Que ela sabe que eu não vou sair hoje | Que eu não vou sair hoje"
    )
    assert reactions(tokens).first().reactions == "Vou sair hoje"


def tree_rows(entry_id, sent_no, first, heads):
    return [
        (
            entry_id, sent_no, first + i, first + h if h is not None else 0,
            f"w{first + i}", " ", "x", "X", "dep", None, None, False,
        )
        for i, h in enumerate(heads)
    ]


def below(heads, seed):
    found, grew = {seed}, True
    while grew:
        more = {i for i, h in enumerate(heads) if h in found} - found
        found |= more
        grew = bool(more)
    return found


def check(spark, sentences, seeds):
    """Compare members with a plain closure; ``sentences`` is (entry, sent, first, heads)."""
    rows = [row for s in sentences for row in tree_rows(*s)]
    tokens = spark.createDataFrame(rows, TOKEN)
    wanted = {
        (e, s, f + seed, f + member)
        for e, s, f, heads in sentences
        for seed in seeds(heads)
        for member in below(heads, seed)
    }
    table = spark.createDataFrame(
        [(e, s, f + seed) for e, s, f, heads in sentences for seed in seeds(heads)],
        "entry_id bigint, sent_no int, seed int",
    )
    got = [tuple(r) for r in oc.subtree_members(tokens, table).select("entry_id", "sent_no", "seed", "tok_no").collect()]
    assert set(got) == wanted
    texts = {tuple(r)[:3]: r.subtree for r in oc.subtree_text(tokens, table).collect()}
    by_seed: dict[tuple, list[int]] = {}
    for e, s, seed, tok in sorted(wanted):
        by_seed.setdefault((e, s, seed), []).append(tok)
    assert texts == {k: " ".join(f"w{t}" for t in v) for k, v in by_seed.items()}
    return got, wanted


def test_random_trees(spark):
    rng = random.Random(7)
    sentences = []
    for entry_id in range(12):
        first = 1
        for sent_no in range(1, 4):
            n = rng.randint(1, 25)
            order = list(range(n))
            rng.shuffle(order)
            heads: list[int | None] = [None] * n
            for k in range(1, n):
                heads[order[k]] = order[rng.randrange(k)]
            sentences.append((entry_id, sent_no, first, heads))
            first += n
    got, wanted = check(spark, sentences, lambda heads: [i for i in range(len(heads)) if i % 3 == 0])
    assert len(got) == len(wanted)


def test_deep_chain_takes_few_rounds(spark):
    n = 700
    heads = [None, *range(n - 1)]
    check(spark, [(1, 1, 1, heads)], lambda heads: [0, 350])


def test_cycle_and_self_head_stop(spark):
    heads = [1, 0, 1, 3, None, 4]
    check(spark, [(1, 1, 1, heads), (1, 2, 7, [None, 0])], lambda heads: [0])


def test_no_seeds(spark, make_tokens):
    tokens = make_tokens({1: ["a/a/X/dep/0"]})
    assert oc.clauses(tokens).count() == 0


def test_long_sentence_with_many_seeds(spark):
    """5,000 words, 1,000 of them seeds, in a tree that is deep on one side and wide on the other."""
    rng = random.Random(4)
    n = 5000
    heads: list[int | None] = [None, *range(1499)]
    heads += [rng.randrange(0, i) if i % 3 else 1200 for i in range(1500, n)]
    tokens = spark.createDataFrame(tree_rows(1, 1, 1, heads), TOKEN)
    wanted = [5 * i for i in range(1000)]
    seeds = spark.createDataFrame([(1, 1, s + 1) for s in wanted], "entry_id bigint, sent_no int, seed int")
    started = time.monotonic()
    got = {r.seed: r.subtree for r in oc.subtree_text(tokens, seeds).collect()}
    assert time.monotonic() - started < 60
    for s in (0, 5, 1000, 1200, 1205, 4995):
        assert got[s + 1] == " ".join(f"w{t + 1}" for t in sorted(below(heads, s)))
    assert len(got) == 1000


def test_intervals_hold_all_at_or_below():
    rng = random.Random(11)
    for _ in range(200):
        n = rng.randint(1, 30)
        up = [rng.randint(-1, n - 1) for _ in range(n)]  # cycles, self heads and forests
        order, first, last = oc.preorder_of(up)
        assert sorted(order) == list(range(n))
        heads = [None if u < 0 or u == i else u for i, u in enumerate(up)]
        for i in range(n):
            assert set(order[first[i] : last[i]]) == below(heads, i)


def test_seeds_and_subtrees_of_long_entries_and_odd_rows(spark):
    """Look-ups cross their blocks of 512 numbers; rows that come twice match twice, null matches nothing."""
    verb, child = "acho achar VERB root".split(), "vai ir VERB ccomp".split()

    def token(entry_id, sent_no, tok_no, head, word):
        return (entry_id, sent_no, tok_no, head, word[0], " ", *word[1:], None, None, False)

    rows = [token(1, s, 2 * s + k, 2 * s, (verb, child)[k]) for s in range(-3, 1200) for k in (0, 1)]
    rows += [token(2, 7, 1, 0, verb)] * 2 + [token(2, 7, 2, 1, child)] * 3 + [token(2, 8, 3, 1, child)]
    rows += [token(None, 1, 1, 0, verb), token(None, 1, 2, 1, child), token(3, None, 1, 0, verb), token(3, None, 2, 1, child), token(4, 1, None, 0, verb), token(4, 1, 2, None, child)]
    tokens = spark.createDataFrame(rows, TOKEN).repartition(3)
    seeds = oc.clause_seeds(tokens)
    assert seeds.columns == ["entry_id", "sent_no", "seed", "kind", "verb_tok", "verb_text"]
    want = [(1, s, 2 * s + 1, "thought", 2 * s, "acho") for s in range(-3, 1200)] + [(2, 7, 2, "thought", 1, "acho")] * 6
    assert sorted(map(tuple, seeds.collect())) == want
    texts = sorted(map(tuple, oc.subtree_text(tokens, seeds.withColumn("sent_no", seeds.sent_no.cast("bigint"))).collect()))
    assert texts[:-3] == [(1, s, 2 * s + 1, "vai") for s in range(-3, 1200)]
    assert {t[:3] for t in texts[-3:]} == {(2, 7, 2)}
    gone = spark.createDataFrame([(None, 1, 1), (3, None, 1), (9, 1, 1), (1, 5, None), (1, 5000, 2)], "entry_id bigint, sent_no int, seed int")
    assert oc.subtree_text(tokens, gone).count() == 0
