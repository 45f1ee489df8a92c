from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ed", "ing", ","]) + str(r.randrange(40)) * (r.random() < 0.3) for _ in range(n))


LINE = "  This line of text is found in many documents of the table.\t"
SHARED = prose(99, 60)
LONG = "\n".join(prose(s, 30) for s in range(400))


@pytest.fixture(scope="session")
def rows():
    """Ids and texts: null, empty, blank, very long, equal, repeated and near texts."""
    texts = [
        None, "", " \n\t ", "x", "Ärger", "a b", prose(1, 80), prose(1, 80), prose(2, 300), LONG,
        LONG + " end", "\n".join([LINE, prose(3, 20)]), "\n".join([prose(4, 20), LINE.upper(), LINE]),
        prose(5, 50) + " " + SHARED + " " + prose(6, 30), prose(7, 10) + "\n" + SHARED,
        SHARED + " " + SHARED, "na " * 200, "\U0001f600 " * 50 + prose(8, 20), "日本語 " * 60,
    ]
    texts += [LINE + "\n" + prose(10 + i, 15) for i in range(6)]
    near = prose(30, 200).split()
    texts += [" ".join(near[:k] + ["other"] + near[k + 1 :]) for k in (20, 90, 150)] + [" ".join(near)]
    texts += ["1234 5678 !!", None, ""]
    return [(7 * i % 101 - 3, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with further columns whose names operators might use inside."""
    data = [(i, t, "en" if i % 2 else None, "s", 5, 1, 2, b"3", "4", 5.0) for i, t in rows]
    schema = (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, "
        "chunk int, shard int, keys binary, node string, score double"
    )
    return spark.createDataFrame(data, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def odd(spark, docs):
    """Repeated rows and null ids."""
    more = spark.createDataFrame([(None, prose(1, 80)), (None, None), (None, prose(2, 300))], "doc_id bigint, text string")
    return docs.select("doc_id", "text").union(docs.select("doc_id", "text").where("doc_id % 3 = 0")).union(more)


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
