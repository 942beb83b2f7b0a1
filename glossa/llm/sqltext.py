"""Word expressions of the native operators (Catalyst functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """Words of a text as an array (no words: an empty array)."""
    trimmed = F.btrim(text_or_empty(text), F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")
