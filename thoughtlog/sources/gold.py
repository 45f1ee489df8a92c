"""Expected polarity per persona."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from thoughtlog.sources.sizes import literal_table

# The label expected of each planned persona.
GOLD = {
    "Persona_A": "POSITIVE",
    "Persona_B": "NEGATIVE",
    "Persona_C": "NEGATIVE",
    "Persona_D": "NEUTRAL",
    "Persona_E": "NEGATIVE",
}


def gold_table(spark: SparkSession, gold: Mapping[str, str] | None = None) -> DataFrame:
    """Dimension table ``persona, expected``."""
    gold = GOLD if gold is None else gold
    return literal_table(
        spark, sorted(gold.items()), persona=pa.string(), expected=pa.string()
    )
