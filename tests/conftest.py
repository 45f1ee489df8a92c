from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from thoughtlog.schemas import ENTRY, TOKEN  # noqa: E402


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .appName("thoughtlog-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_entries(spark):
    def make(rows: list[tuple]) -> DataFrame:
        return spark.createDataFrame(rows, ENTRY)

    return make


@pytest.fixture(scope="session")
def make_tokens(spark):
    """Token table from sentences of ``text lemma pos dep head [label]`` words.

    Words are written ``text/lemma/pos/dep/head``; the head counts within the sentence. A word
    that starts with ``_`` follows the one before without a space; labels are given after ``@``,
    and words next to each other with the same label are one entity.
    """

    def make(entries: dict[int, list[str]]) -> DataFrame:
        rows = []
        for entry_id, sentences in entries.items():
            tok_no, ent_id, previous = 0, 0, None
            for sent_no, sentence in enumerate(sentences, 1):
                start = tok_no
                words = sentence.split()
                for i, word in enumerate(words):
                    word, _, label = word.partition("@")
                    text, lemma, pos, dep, head = word.split("/")
                    tok_no += 1
                    follows = i + 1 < len(words) and words[i + 1].startswith("_")
                    if label and label != previous:
                        ent_id += 1
                    previous = label or None
                    rows.append(
                        (
                            entry_id,
                            sent_no,
                            tok_no,
                            start + int(head) if int(head) else 0,
                            text.lstrip("_"),
                            "" if follows else " ",
                            lemma.lstrip("_") or text.lstrip("_").lower(),
                            pos,
                            dep,
                            ent_id if label else None,
                            label or None,
                            pos in ("DET", "PRON", "ADP", "SCONJ"),
                        )
                    )
        return spark.createDataFrame(rows, TOKEN)

    return make
