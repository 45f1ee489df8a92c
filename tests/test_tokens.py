from __future__ import annotations

from pyspark.sql import functions as F

from thoughtlog.operators import membership, phrases
from thoughtlog.operators import tokens as ot
from thoughtlog.operators.keywords import keyword_tokens, keywords, term_frequency, top_terms
from thoughtlog.sources.lexicons import PORTUGUESE, Lexicon, lexicon_tables
from thoughtlog.testing import fixture_pack as fx


def test_split_sentences(make_entries):
    df = make_entries([(1, "a", "Oi!  Tudo bem?\nSim. "), (2, "a", ""), (3, "a", None)])
    got = [tuple(r) for r in ot.split_sentences(df).orderBy("entry_id", "sent_no").collect()]
    assert got == [(1, 1, "Oi!"), (1, 2, "Tudo bem?"), (1, 3, "Sim."), (1, 4, "")]


def test_tokenize_numbers_without_gaps(make_entries):
    df = make_entries([(1, "a", "Não fui. Ela foi às 8h!"), (2, "a", None)])
    rows = ot.tokenize(df).orderBy("tok_no").collect()
    assert [(r.sent_no, r.tok_no, r.text, r.lemma) for r in rows] == [
        (1, 1, "Não", "não"),
        (1, 2, "fui", "fui"),
        (2, 3, "Ela", "ela"),
        (2, 4, "foi", "foi"),
        (2, 5, "às", "às"),
        (2, 6, "8h", "8h"),
    ]


def test_tokenize_with_lemma_table(spark, make_entries):
    lemmas = spark.createDataFrame([("fui", "ir"), ("foi", "ir")], "form string, lemma string")
    df = make_entries([(1, "a", "Fui. Ela foi")])
    got = [r.lemma for r in ot.tokenize(df, lemmas).orderBy("tok_no").collect()]
    assert got == ["ir", "ela", "ir"]


def test_annotators_agree(make_entries):
    df = make_entries([(1, "a", "The And then. Thanedble The Anea with X from\nthis"), (2, "a", None)])
    one = sorted(map(str, fx.annotate(df).collect()))
    two = sorted(map(str, ot.annotate(df, fx.batch_annotator(), 2).collect()))
    assert one == two and len(one) == 10


def test_sentence_texts_use_own_spaces(make_tokens):
    tokens = make_tokens({1: ["Oi/oi/INTJ/root/0 _,/,/PUNCT/punct/1 Ana/Ana/PROPN/voc/1 _!/!/PUNCT/punct/1"]})
    assert ot.sentence_texts(tokens).first().sentence == "Oi, Ana!"


def test_context_and_entities(make_tokens):
    tokens = make_tokens(
        {
            1: [
                "Fui/ir/VERB/root/0 ao/ao/ADP/case/3 Trabalho/Trabalho/NOUN/obl/1",
                "Vi/ver/VERB/root/0 Ana/Ana/PROPN/obj/1@PER Maria/Maria/PROPN/flat/2@PER",
                "Na/na/ADP/case/2 Petrobras/Petrobras/PROPN/root/0@ORG",
            ]
        }
    )
    assert [r.sent_no for r in ot.context_sentences(tokens, PORTUGUESE).collect()] == [1]
    got = [(r.sent_no, r.first_tok, r.entity) for r in ot.person_place_entities(tokens).collect()]
    assert got == [(2, 5, "Ana Maria")]


def words(*lemmas: str) -> str:
    return " ".join(f"{w}/{w}/X/dep/0" for w in lemmas)


def matches(tokens, lexicon=PORTUGUESE):
    rows = phrases.match_phrases(tokens, lexicon).collect()
    return sorted((r.entry_id, r.category, r.start_tok, r.end_tok) for r in rows)


def test_phrases(make_tokens):
    tokens = make_tokens(
        {
            1: [words("o", "coração", "acelerar", "muito", "suor", "frio")],
            2: [words("coração", "muito", "acelerar")],
            3: [words("nó", "no"), words("estômago", "e", "raiva")],
            4: [words("Raiva", "triste", "triste")],
        }
    )
    assert matches(tokens) == [
        (1, "Ansiedade", 2, 4),
        (1, "Ansiedade", 5, 7),
        (3, "Ansiedade", 1, 4),
        (3, "Raiva", 5, 6),
        (4, "Angústia", 2, 3),
        (4, "Angústia", 3, 4),
    ]
    emotions = phrases.emotion_set(phrases.match_phrases(tokens)).collect()
    assert {r.entry_id: r.emotions for r in emotions} == {
        1: "Ansiedade",
        3: "Ansiedade, Raiva",
        4: "Angústia",
    }


def test_phrases_with_repeated_lemmas_and_overlaps(make_tokens):
    lexicon = Lexicon((), frozenset(), frozenset(), frozenset(), frozenset(), {"c": ("a a", "a b a"), "d": (["a b"],)})
    tokens = make_tokens({1: [words("a", "a", "a", "b", "a", "b", "a")]})
    want = []
    sequence = ["a", "a", "a", "b", "a", "b", "a"]
    for _, category, lemmas in lexicon.phrases():
        for i in range(len(sequence)):
            if sequence[i : i + len(lemmas)] == lemmas:
                want.append((1, category, i + 1, i + 1 + len(lemmas)))
    assert matches(tokens, lexicon) == sorted(want)


def test_lexicon_sizes(spark):
    tables = lexicon_tables(spark)
    counts = {r["list"]: r["count"] for r in tables["words"].groupBy("list").count().collect()}
    assert counts == {"context_nouns": 15, "cognitive_verbs": 8, "action_verbs": 10, "stopwords": 10}
    assert {r.category: r["count"] for r in tables["phrases"].groupBy("category").count().collect()} == {
        "Ansiedade": 7,
        "Angústia": 6,
        "Raiva": 6,
        "Exaustão": 6,
    }


def test_long_word_lists_become_joins(spark, monkeypatch):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "w string")
    for limit in (2_000, 0):
        monkeypatch.setattr(membership, "LITERAL_WORDS", limit)
        kept = membership.keep_members(df, F.col("w"), {"a", "z"}).collect()
        dropped = membership.drop_members(df, F.col("w"), {"a", "z"}).collect()
        assert [r.w for r in kept] == ["a"]
        assert sorted(str(r.w) for r in dropped) == ["None", "b"]


def test_keywords(make_tokens, spark):
    tokens = make_tokens(
        {
            1: ["Casa/Casa/NOUN/x/0 o/o/DET/x/1 mau/mau/ADJ/x/1 Dia/Dia/NOUN/x/1 ir/ir/VERB/x/1 casa/casa/NOUN/x/1"],
            2: ["é/é/ADJ/x/0 um/um/NUM/x/1 lá/lá/ADV/x/1"],
        }
    )
    assert [r.keyword for r in keyword_tokens(tokens).orderBy("tok_no").collect()] == ["casa", "mau", "casa"]
    assert [tuple(r) for r in keywords(tokens).collect()] == [(1, "casa mau casa")]
    df = spark.createDataFrame(
        [("p", "b a a"), ("p", "c b"), ("p", None), ("p", ""), ("q", "z")], "persona string, keywords string"
    )
    tf = term_frequency(df)
    assert {(r.persona, r.term): r.n for r in tf.collect()} == {
        ("p", "a"): 2,
        ("p", "b"): 2,
        ("p", "c"): 1,
        ("q", "z"): 1,
    }
    top = [(r.persona, r.term, r["rank"]) for r in top_terms(tf, 2).orderBy("persona", "rank").collect()]
    assert top == [("p", "a", 1), ("p", "b", 2), ("q", "z", 1)]


def test_lemma_forms_meet_in_one_reading(spark, tmp_path):
    """Forms and their stems come from one pass over the texts, and are those of a join of the two."""
    from workload.queries import singular_forms

    words = ["cat", "cats", "dogs", "s", "ss", "sss", "is", "i", "é", "és", "bus"]
    spark.createDataFrame([(w,) for w in words], "form string").write.parquet(f"{tmp_path}/forms")
    found = singular_forms(spark.read.parquet(f"{tmp_path}/forms").distinct())
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    assert sorted(map(tuple, found.collect())) == sorted((w + "s", w) for w in words if w + "s" in words)
