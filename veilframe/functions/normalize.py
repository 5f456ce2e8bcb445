"""Normalisation rules of linkage values, and the text predicates."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from veilframe.functions.hashing import java_trim

#: Umlauts and what they are written as.
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"}
#: Patterns of names and abbreviations.
TYPE_NAME, VERSION, ABBREVIATION = r"^[A-Za-z][A-Za-z0-9_\-]*$", r"^\d+(\.\d+)*$", r"^[A-Za-z0-9_\-]{1,15}$"


@F.pandas_udf(T.StringType())
def ascii_fold(values: pd.Series) -> pd.Series:
    """Canonical decomposition without marks; Spark has no built-in for it."""
    return values.map(lambda v: v if v is None or v.isascii() else "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c)[0] != "M"))


def umlaut_fold(c: Column) -> Column:
    for sign, written in UMLAUTS.items():
        c = F.replace(c, F.lit(sign), F.lit(written))
    return c


RULES = {
    "trim": java_trim,
    "lower": F.lower,
    "collapseWhitespace": lambda c: F.regexp_replace(c, r"\s+", " "),
    "removePunctuation": lambda c: F.regexp_replace(c, r"\p{Punct}", ""),
    "digitsOnly": lambda c: F.regexp_replace(c, r"[^0-9]", ""),
    "umlautFold": umlaut_fold,
    "asciiFold": ascii_fold,
}


def blank(c: Column) -> Column:
    """Null or Unicode white space only."""
    return c.isNull() | ~c.rlike(r"(?U)\S")


def normalize(c: Column, rules: Sequence[str]) -> Column:
    """The rules one after the other; unknown rules are passed over; a blank result is null."""
    for rule in rules:
        c = RULES.get(rule, lambda x: x)(c)
    return F.when(~blank(c), c)


def iso_date(c: Column) -> Column:
    """yyyy-MM-dd of an ISO date, an offset being left aside; null if it is none."""
    t = java_trim(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}(Z|[+-]\d{2}:\d{2})?$"), F.date_format(F.substring(t, 1, 10).try_cast("date"), "yyyy-MM-dd"))


def year_block(c: Column) -> Column:
    return F.substring(iso_date(c), 1, 4)


def year_month_block(c: Column) -> Column:
    return F.substring(iso_date(c), 1, 7)


def prefix_block(c: Column, n: int) -> Column:
    """The first n signs, null for a shorter value."""
    return F.when(F.length(c) >= n, F.substring(c, 1, n))
