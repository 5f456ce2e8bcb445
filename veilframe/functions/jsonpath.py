"""Values under a dotted path of JSON text, through arrays at every level."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import functions as F, types as T

from veilframe.functions.jsondoc import clean, parse_any, text_of


def descend(value: Any, names: list[str]) -> list[str]:
    """Texts of the scalars that the names lead to; arrays on the way and at the end are gone through, objects at the
    end and blank texts are left out."""
    if isinstance(value, list):
        return [text for item in value for text in descend(item, names)]
    if names:
        return descend(value[names[0]], names[1:]) if isinstance(value, dict) and names[0] in value else []
    text = None if isinstance(value, dict) else text_of(value)
    return [clean(text)] if text is not None and text.strip() else []


def values(path: str):
    """A pandas function from documents to the array of values; null for null and for what is no JSON."""
    names = path.split(".")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(documents: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str] | None:
            value = None if text is None else parse_any(text)
            return None if value is None else descend(value, names)

        return documents.map(one)

    return run
