"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a company name that do not identify it.
NAME_FILLERS = (
    "the|inc|incorporated|corp|corporation|co|company|companies|ltd|limited|plc|llc"
    "|lp|l\\s?p|n\\s?v|s\\s?a|ag|se|holdings?|group|international|intl|trust|bancorp"
)


def company_name(col: Column) -> Column:
    """Lower case, ``&`` as and, state tags, punctuation and filler words off, blanks squeezed."""
    s = F.regexp_replace(F.replace(F.lower(col), F.lit("&"), F.lit(" and ")), "/[a-z]{2,4}/?", " ")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 ]+", " "), f"\\b(?:{NAME_FILLERS})\\b", " ")
    return F.trim(F.regexp_replace(s, "\\s+", " "))
