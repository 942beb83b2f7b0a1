"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(col: Column, places: int = 6) -> Column:
    """Round to ``places`` and normalise -0.0 to 0.0 (adding 0.0 does that
    in IEEE arithmetic), so equal numbers print and hash equally."""
    return F.round(col, places) + F.lit(0.0)
