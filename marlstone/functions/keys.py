"""Column functions for keys: one spelling, stable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as surrounding blanks.
BLANKS = " \t\n\r\f\v\u00a0\u2007\u202f\u200b\ufeff"


def norm_key(c: Column) -> Column:
    """Lower case without surrounding blanks; null stays null."""
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def row_hash(*cols: Column) -> Column:
    """64-bit hash of a row in which null is a value of its own and differs from ''."""
    parts = []
    for c in cols:
        parts += [c, c.isNull()]
    return F.xxhash64(*parts)


def stable_double(c: Column, digits: int = 6) -> Column:
    """Rounded double without negative zero, so equal values hash alike."""
    return F.round(c, digits) + F.lit(0.0)
