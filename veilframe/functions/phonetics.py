"""Phonetic codes of names, from the published descriptions of the two algorithms."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Codes of single letters in the Cologne system; c, d, p, t and x depend on their neighbours.
COLOGNE = {**dict.fromkeys("AEIJOUY", "0"), "B": "1", "P": "1", "D": "2", "T": "2", **dict.fromkeys("FVW", "3"), **dict.fromkeys("GKQ", "4"), "L": "5", "M": "6", "N": "6", "R": "7", "S": "8", "Z": "8"}


@lru_cache(maxsize=100_000)
def cologne(text: str) -> str:
    """Cologne phonetics: digits by sound, equal neighbours once, zeros only in front."""
    signs = text.upper().replace("ß", "S").translate(str.maketrans("ÄÖÜ", "AOU"))
    out, last = "", ""
    for k, c in enumerate(signs):
        if not "A" <= c <= "Z":
            continue
        before, after = signs[k - 1] if k else "", signs[k + 1] if k + 1 < len(signs) else ""
        if c == "H":  # silent, but keeps equal sounds apart
            last = "-"
            continue
        if c == "P" and after == "H":
            codes = "3"
        elif c in "DT" and after and after in "CSZ":
            codes = "8"
        elif c == "X":
            codes = "8" if before and before in "CKQ" else "48"
        elif c == "C":
            codes = "4" if after and after in ("AHKOQUX" if out else "AHKLOQRUX") and not (out and before and before in "SZ") else "8"
        else:
            codes = COLOGNE[c]
        for code in codes:
            if code != last and (code != "0" or not out):
                out += code
            last = code
    return out


_VOWELS = "AEIOUY"


class _Word:
    """A word with safe access around its ends."""

    def __init__(self, text: str) -> None:
        self.text, self.size = text, len(text)

    def at(self, k: int) -> str:
        return self.text[k] if 0 <= k < self.size else ""

    def has(self, start: int, *options: str) -> bool:
        return start >= 0 and any(start + len(o) <= self.size and self.text.startswith(o, start) for o in options)

    def vowel(self, k: int) -> bool:
        c = self.at(k)
        return bool(c) and c in _VOWELS


@lru_cache(maxsize=100_000)
def double_metaphone(text: str, most: int = 4) -> str:
    """The primary Double Metaphone code, at most ``most`` signs."""
    text = text.strip().upper()
    if not text:
        return ""
    w = _Word(text)
    slavic = "W" in text or "K" in text or "CZ" in text or "WITZ" in text
    out: list[str] = []
    k = 1 if w.has(0, "GN", "KN", "PN", "WR", "PS") else 0
    while k < w.size and sum(map(len, out)) < most:
        code, k = _step(w, k, slavic)
        out.append(code)
    return "".join(out)[:most]


def _step(w: _Word, k: int, slavic: bool) -> tuple[str, int]:
    """The code at position k and the next position."""
    c, last = w.at(k), w.size - 1
    twice = lambda x: k + 2 if w.at(k + 1) == x else k + 1
    if c in _VOWELS:
        return ("A" if k == 0 else ""), k + 1
    if c == "B":
        return "P", twice("B")
    if c in "Ç":
        return "S", k + 1
    if c == "C":
        return _c(w, k)
    if c == "D":
        if w.has(k, "DG"):
            return ("J", k + 3) if w.has(k + 2, "I", "E", "Y") else ("TK", k + 2)
        return "T", k + 2 if w.has(k, "DT", "DD") else k + 1
    if c == "F":
        return "F", twice("F")
    if c == "G":
        return _g(w, k, slavic)
    if c == "H":
        return ("H", k + 2) if (k == 0 or w.vowel(k - 1)) and w.vowel(k + 1) else ("", k + 1)
    if c == "J":
        return _j(w, k, slavic)
    if c == "K":
        return "K", twice("K")
    if c == "L":
        return "L", twice("L")
    if c == "M":
        skip = w.at(k + 1) == "M" or (w.has(k - 1, "UMB") and (k + 1 == last or w.has(k + 2, "ER")))
        return "M", k + 2 if skip else k + 1
    if c == "N":
        return "N", twice("N")
    if c == "Ñ":
        return "N", k + 1
    if c == "P":
        return ("F", k + 2) if w.at(k + 1) == "H" else ("P", k + 2 if w.has(k + 1, "P", "B") else k + 1)
    if c == "Q":
        return "K", twice("Q")
    if c == "R":
        silent = k == last and not slavic and w.has(k - 2, "IE") and not w.has(k - 4, "ME", "MA")
        return "" if silent else "R", twice("R")
    if c == "S":
        return _s(w, k, slavic)
    if c == "T":
        if w.has(k, "TION") or w.has(k, "TIA", "TCH"):
            return "X", k + 3
        if w.has(k, "TH", "TTH"):
            return ("T" if w.has(k + 2, "OM", "AM") or w.has(0, "VAN ", "VON ", "SCH") else "0"), k + 2
        return "T", k + 2 if w.has(k + 1, "T", "D") else k + 1
    if c == "V":
        return "F", twice("V")
    if c == "W":
        if w.has(k, "WR"):
            return "R", k + 2
        if k == 0 and (w.vowel(k + 1) or w.has(k, "WH")):
            return "A", k + 1
        if (k == last and w.vowel(k - 1)) or w.has(k - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or w.has(0, "SCH"):
            return "", k + 1
        return ("TS", k + 4) if w.has(k, "WICZ", "WITZ") else ("", k + 1)
    if c == "X":
        if k == 0:
            return "S", k + 1
        silent = k == last and (w.has(k - 3, "IAU", "EAU") or w.has(k - 2, "AU", "OU"))
        return "" if silent else "KS", k + 2 if w.has(k + 1, "C", "X") else k + 1
    if c == "Z":
        if w.at(k + 1) == "H":
            return "J", k + 2
        return "S", twice("Z")
    return "", k + 1


def _c(w: _Word, k: int) -> tuple[str, int]:
    germanic = k > 1 and not w.vowel(k - 2) and w.has(k - 1, "ACH") and w.at(k + 2) != "I" and (w.at(k + 2) != "E" or w.has(k - 2, "BACHER", "MACHER"))
    if germanic:
        return "K", k + 2
    if k == 0 and w.has(k, "CAESAR"):
        return "S", k + 2
    if w.has(k, "CH"):
        if k > 0 and w.has(k, "CHAE"):
            return "K", k + 2
        if k == 0 and (w.has(k + 1, "HARAC", "HARIS") or w.has(k + 1, "HOR", "HYM", "HIA", "HEM")) and not w.has(0, "CHORE"):
            return "K", k + 2
        if w.has(0, "VAN ", "VON ", "SCH") or w.has(k - 2, "ORCHES", "ARCHIT", "ORCHID") or w.has(k + 2, "T", "S") or (
            (w.has(k - 1, "A", "O", "U", "E") or k == 0) and (w.has(k + 2, "L", "R", "N", "M", "B", "H", "F", "V", "W", " ") or k + 1 == w.size - 1)
        ):
            return "K", k + 2
        return ("K" if w.has(0, "MC") else "X") if k > 0 else "X", k + 2
    if w.has(k, "CZ") and not w.has(k - 2, "WICZ"):
        return "S", k + 2
    if w.has(k + 1, "CIA"):
        return "X", k + 3
    if w.has(k, "CC") and not (k == 1 and w.at(0) == "M"):
        if w.has(k + 2, "I", "E", "H") and not w.has(k + 2, "HU"):
            hard = (k == 1 and w.at(k - 1) == "A") or w.has(k - 1, "UCCEE", "UCCES")
            return ("KS" if hard else "X"), k + 3
        return "K", k + 2
    if w.has(k, "CK", "CG", "CQ"):
        return "K", k + 2
    if w.has(k, "CI", "CE", "CY"):
        return "S", k + 2
    if w.has(k + 1, " C", " Q", " G"):
        return "K", k + 3
    return "K", k + 2 if w.has(k + 1, "C", "K", "Q") and not w.has(k + 1, "CE", "CI") else k + 1


def _g(w: _Word, k: int, slavic: bool) -> tuple[str, int]:
    nxt = w.at(k + 1)
    if nxt == "H":
        if k > 0 and not w.vowel(k - 1):
            return "K", k + 2
        if k == 0:
            return ("J" if w.at(k + 2) == "I" else "K"), k + 2
        if (k > 1 and w.has(k - 2, "B", "H", "D")) or (k > 2 and w.has(k - 3, "B", "H", "D")) or (k > 3 and w.has(k - 4, "B", "H")):
            return "", k + 2
        if k > 2 and w.at(k - 1) == "U" and w.has(k - 3, "C", "G", "L", "R", "T"):
            return "F", k + 2
        return ("K" if k > 0 and w.at(k - 1) != "I" else ""), k + 2
    if nxt == "N":
        if k == 1 and w.vowel(0) and not slavic:
            return "KN", k + 2
        if not w.has(k + 2, "EY") and w.at(k + 1) != "Y" and not slavic:
            return "N", k + 2
        return "KN", k + 2
    if w.has(k + 1, "LI") and not slavic:
        return "KL", k + 2
    soft = ("ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")
    if k == 0 and (nxt == "Y" or w.has(k + 1, *soft)):
        return "K", k + 2
    if (w.has(k + 1, "ER") or nxt == "Y") and not w.has(0, "DANGER", "RANGER", "MANGER") and not w.has(k - 1, "E", "I") and not w.has(k - 1, "RGY", "OGY"):
        return "K", k + 2
    if w.has(k + 1, "E", "I", "Y") or w.has(k - 1, "AGGI", "OGGI"):
        if w.has(0, "VAN ", "VON ", "SCH") or w.has(k + 1, "ET"):
            return "K", k + 2
        return "J", k + 2
    return "K", k + 2 if nxt == "G" else k + 1


def _j(w: _Word, k: int, slavic: bool) -> tuple[str, int]:
    if w.has(k, "JOSE") or w.has(0, "SAN "):
        alone = (k == 0 and w.at(k + 4) == " ") or w.size == 4 or w.has(0, "SAN ")
        return ("H" if alone else "J"), k + 1
    step = k + 2 if w.at(k + 1) == "J" else k + 1
    if k == 0:
        return "J", step
    if w.vowel(k - 1) and not slavic and w.has(k + 1, "A", "O"):
        return "J", step
    if k == w.size - 1:
        return "J", step
    silent = w.has(k + 1, "L", "T", "K", "S", "N", "M", "B", "Z") or w.has(k - 1, "S", "K", "L")
    return ("" if silent else "J"), step


def _s(w: _Word, k: int, slavic: bool) -> tuple[str, int]:
    if w.has(k - 1, "ISL", "YSL"):
        return "", k + 1
    if k == 0 and w.has(k, "SUGAR"):
        return "X", k + 1
    if w.has(k, "SH"):
        return ("S" if w.has(k + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X"), k + 2
    if w.has(k, "SIO", "SIA") or w.has(k, "SIAN"):
        return ("S" if slavic else "S"), k + 3
    if (k == 0 and w.has(k + 1, "M", "N", "L", "W")) or w.has(k + 1, "Z"):
        return "S", k + 2 if w.has(k + 1, "Z") else k + 1
    if w.has(k, "SC"):
        if w.at(k + 2) == "H":
            if w.has(k + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                return ("X" if w.has(k + 3, "ER", "EN") else "SK"), k + 3
            return "X", k + 3
        return ("S" if w.has(k + 2, "I", "E", "Y") else "SK"), k + 3
    silent = k == w.size - 1 and w.has(k - 2, "AI", "OI")
    return ("" if silent else "S"), k + 2 if w.has(k + 1, "S", "Z") else k + 1


ENCODERS = {"cologne": cologne, "doublemetaphone": double_metaphone}


def encode(encoder: str):
    """The pandas function of an encoder by name (case ignored); an unknown one gives nulls, as do blank texts."""
    one = ENCODERS.get(encoder.lower())

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if one is None or v is None or not v.strip() else one(v))

    return run


def encode_distinct(rows: DataFrame, value: str, encoder: str, name: str) -> DataFrame:
    """``rows`` with the code of a column as ``name``: each different value is encoded once and joined back."""
    codes = rows.select(F.col(value).alias("_v")).where("_v is not null").distinct().withColumn(name, encode(encoder)(F.col("_v")))
    return rows.join(codes, F.col(value) == F.col("_v"), "left").drop("_v")


def code(c: Column, encoder: str) -> Column:
    return encode(encoder)(c)
