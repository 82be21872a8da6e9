"""Integer dialects of the sources; each treats separators and fractions in its own way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coerce_int(c: Column, default: int = 0) -> Column:
    """1,234 is 1234; fractions and other text are the default."""
    clean = F.regexp_replace(F.trim(c), ",", "")
    return F.coalesce(F.when(clean.rlike(r"^[+-]?\d+$"), clean.try_cast("long")), F.lit(default))


def truncated_int(c: Column, default: int = 0) -> Column:
    """1,234 is 1234 and 800.9 is 800; other text is the default."""
    number = F.regexp_replace(F.trim(c), ",", "").try_cast("double")
    return F.coalesce(number.try_cast("long"), F.lit(default))


def plain_int(c: Column, default: int = 0) -> Column:
    """Digits only; separators, fractions and other text are the default."""
    clean = F.trim(c)
    return F.coalesce(F.when(clean.rlike(r"^[+-]?\d+$"), clean.try_cast("long")), F.lit(default))


def nullable_int(c: Column) -> Column:
    """Blank is null, and so is what is no integer, where a strict cast would fail the whole batch."""
    return F.nullif(F.trim(c), F.lit("")).try_cast("int")
