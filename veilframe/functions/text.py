"""Text expressions shared by operators and queries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space at either end, of any kind.
EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Trimmed of surrounding white space of any kind (``trim`` takes blanks only)."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | (strip(c) == "")
