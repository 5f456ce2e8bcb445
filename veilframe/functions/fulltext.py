"""Full-text lexemes, rank and trigram similarity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def lexemes(text: Column) -> Column:
    """Different lower-case words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def is_json(data: Column) -> Column:
    """Whether a text is one complete JSON value with nothing but white space around it.

    Spark's parsers read one value and ignore what follows it; what follows can't go on both an array and an object, so
    within both the value must be the only one.
    """
    alone = (F.json_array_length(F.concat(F.lit("["), data, F.lit("]"))) == 1) & (F.size(F.json_object_keys(F.concat(F.lit('{"":'), data, F.lit("}")))) == 1)
    return F.coalesce(F.try_parse_json(data).isNotNull() & alone, F.lit(False))


def json_text(data: Column) -> Column:
    """The string values of a JSON document, unescaped, without names and numbers, joined by blanks; null for what is no
    JSON.

    Every string is matched from its opening quote, names with their colon, so that no text within quotes is taken for
    a string of its own; the values together are read once more as one JSON array, which undoes the escapes. The
    repetitions are possessive: others are matched by recursion, a call per sign, and a long string's overflow of the
    stack ends the executor.
    """
    strings = F.regexp_extract_all(data, F.lit(r'"(?:[^"\\]++|\\.)*+"(?:\s*+:)?+'), F.lit(0))
    values = F.filter(strings, lambda s: ~s.endswith(":"))
    read = F.from_json(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>")
    return F.when(is_json(data), F.array_join(read, " "))


def _signs(part: str) -> str:
    return "".join(c for c in part.lower() if c.isalnum())


def may_hold(data: Column, part: str) -> Column:
    """Whether JSON text may hold a lexeme with the part's letters and digits: it has them, or escapes. Costs no parsing."""
    return F.contains(F.lower(data), F.lit(_signs(part))) | F.contains(data, F.lit("\\"))


def prefix_matches(words: Column, part: str) -> Column:
    """Whether some lexeme begins with the part's letters and digits."""
    wanted = _signs(part)
    return F.exists(words, lambda w: w.startswith(wanted)) if wanted else F.lit(False)


def word_matches(words: Column, part: str) -> Column:
    """Whether all words of the part are lexemes."""
    wanted = [w for w in "".join(c if c.isalnum() else " " for c in part.lower()).split() if w]
    return F.array_size(F.array_intersect(words, F.array(*map(F.lit, wanted)))) == len(set(wanted)) if wanted else F.lit(False)


def rank(words: Column, query: str) -> Column:
    """Share of the query's words that occur; approximates a full-text rank by its order only."""
    wanted = sorted({w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split() if w})
    return F.array_size(F.array_intersect(words, F.array(*map(F.lit, wanted)))) / F.lit(float(len(wanted))) if wanted else F.lit(0.0)


def trigrams(text: Column) -> Column:
    """Different trigrams of the lower-case words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 if there are none."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))
