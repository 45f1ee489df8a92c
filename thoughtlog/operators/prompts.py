"""The planned grid of personas and days, with one writing prompt per cell."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thoughtlog.sources.sizes import literal_table

# Fixed value: planned days per persona.
DAYS = 60

# The planned personas, the text backend of each, and its description.
PERSONAS = (
    (
        "Persona_A",
        "gemini",
        "Mariana, 22 anos, Fortaleza. Melhora gradual. Vocabulário emocional aumenta ao longo "
        "dos dias.",
    ),
    (
        "Persona_B",
        "gemini",
        "Sheldon, 35 anos, São Paulo. Estável com crises isoladas de ansiedade.",
    ),
    (
        "Persona_C",
        "gemini",
        "Letícia, 17 anos, Russas. Declínio. Frases curtas, desamparo crescente.",
    ),
    (
        "Persona_D",
        "mistral",
        "Jorge, 52 anos, Curitiba. Alexitimia severa. Descreve apenas fatos, rotina e "
        "sensações físicas no lugar de emoções.",
    ),
    (
        "Persona_E",
        "mistral",
        "Alex, 28 anos, Porto Alegre. TDAH e autismo. Mudanças abruptas de tópico, relatos de "
        "exaustão social extrema (masking).",
    ),
)

# Fixed value: the prompt of a cell, with its day, the planned days and the description.
PROMPT = (
    "Escreva o dia %d/%d do diário de: %s. Requisito: Retorne estritamente o texto narrativo em "
    "primeira pessoa, com pelo menos 150 palavras, citando locais e pessoas. Sem aspas ou "
    "prefixos."
)


def persona_table(spark: SparkSession) -> DataFrame:
    """``persona_no, persona, backend, prompt`` of the planned personas, in planned order."""
    rows = [(no, *persona) for no, persona in enumerate(PERSONAS)]
    return literal_table(
        spark,
        rows,
        persona_no=pa.int64(),
        persona=pa.string(),
        backend=pa.string(),
        prompt=pa.string(),
    )


def prompt_grid(personas: DataFrame, days: int = DAYS) -> DataFrame:
    """``grid_no, persona_no, persona, day, request``: one row per persona and day.

    ``grid_no`` orders the cells by persona, then day. ``personas`` needs ``persona_no``,
    ``persona`` and ``prompt``.
    """
    cells = personas.select(
        "persona_no",
        "persona",
        "prompt",
        F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day"),
    )
    return cells.select(
        (F.col("persona_no") * days + F.col("day") - 1).alias("grid_no"),
        "persona_no",
        "persona",
        "day",
        F.format_string(PROMPT, "day", F.lit(days), "prompt").alias("request"),
    )
