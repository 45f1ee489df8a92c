"""Explicit schemas and fixed names shared by readers, writers and operators."""

from __future__ import annotations

from pyspark.sql import types as T

ENTRY = T.StructType(
    [
        T.StructField("entry_id", T.LongType()),
        T.StructField("persona", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

PROCESSED = T.StructType(
    ENTRY.fields
    + [
        T.StructField(name, T.StringType())
        for name in (
            "time_anchor",
            "situations",
            "thoughts",
            "emotions",
            "reactions",
            "triggers",
            "polarity",
            "keywords",
        )
    ]
)

# One row per token. tok_no counts from 1 within the entry without gaps, head is the tok_no
# of the governing token (0 for a root), ent_id numbers the entities of an entry.
TOKEN = T.StructType(
    [
        T.StructField("entry_id", T.LongType()),
        T.StructField("sent_no", T.IntegerType()),
        T.StructField("tok_no", T.IntegerType()),
        T.StructField("head", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("ws", T.StringType()),
        T.StructField("lemma", T.StringType()),
        T.StructField("pos", T.StringType()),
        T.StructField("dep", T.StringType()),
        T.StructField("ent_id", T.IntegerType()),
        T.StructField("ent_label", T.StringType()),
        T.StructField("is_stop", T.BooleanType()),
    ]
)

WINDOW_SCORE = T.StructType(
    [
        T.StructField("entry_id", T.LongType()),
        T.StructField("window_no", T.IntegerType()),
        T.StructField("logits", T.ArrayType(T.DoubleType())),
    ]
)

# Headers of the exchanged CSV files, and our column for each.
CSV_COLUMNS = {
    "id_registro": "entry_id",
    "persona": "persona",
    "texto_diario": "text",
    "Data/Hora": "time_anchor",
    "Situação": "situations",
    "Pensamentos": "thoughts",
    "Emoção Física": "emotions",
    "Reação": "reactions",
    "Gatilhos": "triggers",
    "Polaridade (RoBERTa)": "polarity",
    "Palavras_Nuvem": "keywords",
}

# Fixed value: header of the label column in older files.
OLD_POLARITY_HEADER = "Polaridade (BERT)"
OLD_POLARITY_COLUMN = "polarity_old"

# What a record shows for a field in which nothing was found.
NO_TIME_ANCHOR = "Não relatado"
NO_SITUATION = "Não descrita claramente."
NO_THOUGHT = "Não verbalizado."
NO_EMOTION = "Falta léxico."
NO_REACTION = "Sem reação."
NO_TRIGGER = ""

# Polarity classes in canonical order.
CLASSES = ("NEGATIVE", "NEUTRAL", "POSITIVE")
DEFAULT_LABEL = "NEUTRAL"

#: What is found in one sentence: the kind of finding, its place, its text.
FINDINGS = "array<struct<kind:string,ord:bigint,value:string>>"
