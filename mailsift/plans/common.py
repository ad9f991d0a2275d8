"""Small helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailsift.functions.numeric import round6

R6 = round6


def r6(expression: str) -> str:
    """SQL twin of ``round6``."""
    return f"floor(({expression}) * 1e6 + 0.5e0) / 1e6"


def millis(moment: Column | str) -> Column:
    return F.unix_millis(moment if isinstance(moment, Column) else F.col(moment))
