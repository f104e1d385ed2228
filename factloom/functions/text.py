"""String helpers shared by the operators; null and blank both mean absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column | str) -> Column:
    """Without outer white space."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def present(c: Column | str) -> Column:
    """Stripped text, null where blank."""
    s = strip(c)
    return F.when(s != "", s)


def key(c: Column | str) -> Column:
    """Stripped lower-case text, null where blank: how written references are compared."""
    return F.lower(present(c))
