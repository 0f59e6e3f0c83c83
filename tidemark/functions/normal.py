"""Normalisation of the identifiers that arrive spelled in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_DAY = "0001-01-01"
MAX_DAY = "9999-12-31"
NEW_YORK = "America/New_York"


def ticker(col: Column) -> Column:
    """Outer blanks and tabs off, upper case, ``-`` read as ``.``; blank becomes null."""
    t = F.upper(F.btrim(col, F.lit(" \t")))
    return F.nullif(F.translate(t, "-", "."), F.lit(""))


def label(col: Column) -> Column:
    """Case and outer blanks off; null stays null."""
    return F.lower(F.btrim(col, F.lit(" \t")))


def day_in_zone(instant: Column, zone: str = NEW_YORK) -> Column:
    """The calendar day of an instant in a zone (the session zone must be UTC)."""
    return F.to_date(F.from_utc_timestamp(instant, zone))
