"""Persons' attributes out of differently shaped documents, brought to comparable form."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilframe.functions.jsondoc import canonical, digest, known, parse, plain, text_of

#: Where each type that describes persons keeps an attribute (dotted paths). A ``name`` holds first and last together.
PATHS: dict[int, dict[str, str]] = {
    201: {"number": "mrn", "first": "person.first", "last": "person.last", "birth": "person.birth", "sex": "person.sex", "street": "contact.street", "zip": "contact.zip", "phone": "contact.phone", "email": "contact.email"},
    202: {"number": "donorNo", "name": "name", "birth": "dob", "sex": "gender", "address": "address", "phone": "tel", "email": "mail"},
    203: {"number": "subjectNo", "first": "givenName", "last": "familyName", "birth": "birthDate", "sex": "sexAtBirth", "zip": "postcode", "phone": "phone"},
    204: {"number": "nr", "first": "vorname", "last": "nachname", "birth": "geburtsdatum", "sex": "geschlecht", "street": "anschrift.strasse", "zip": "anschrift.plz", "phone": "telefon"},
}
#: How signs outside a to z are written when only these are at hand.
FOLDED = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "ø": "oe", "æ": "ae", "å": "aa", "ł": "l", "đ": "d", "ı": "i"})
#: Words for the two sexes in plain form.
SEXES = {"m": "m", "male": "m", "männlich": "m", "mann": "m", "f": "f", "w": "f", "female": "f", "weiblich": "f", "frau": "f"}

ATTRIBUTES = ["first", "last", "birth", "sex", "street", "zip", "phone", "email"]


def fold(text: str) -> str:
    """Lower-case letters a to z and digits, other signs as one blank."""
    text = unicodedata.normalize("NFC", text).casefold().translate(FOLDED)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", " ", text).strip()


def birth_date(text: str) -> str | None:
    """yyyymmdd of a date written year first or day first, whatever stands between; None if it isn't one."""
    found = re.findall(r"\d+", text)
    if len(found) == 1 and len(found[0]) == 8:
        d = found[0]
        found = [d[:4], d[4:6], d[6:]] if d[:2] in ("18", "19", "20") and int(d[4:6]) <= 12 else [d[:2], d[2:4], d[4:]]
    if len(found) < 3:
        return None
    a, b, c = found[:3]
    if len(a) == 4:
        return f"{a}{b:0>2}{c:0>2}"[:8]
    return f"{c}{b:0>2}{a:0>2}"[:8] if len(c) == 4 else None


def phone_number(text: str) -> str | None:
    """National digits with one leading zero."""
    digits = re.sub(r"\D", "", text)
    if text.lstrip().startswith(("+", "00")):
        digits = re.sub(r"^(00)?49", "", digits)
    elif digits.startswith("49") and len(digits) > 10:
        digits = digits[2:]
    digits = digits.lstrip("0")
    return "0" + digits if len(digits) >= 5 else None


def split_name(text: str) -> tuple[str, str]:
    """First and last of a name written "last, first" or "first last"."""
    if "," in text and fold(text.split(",", 1)[1]):
        last, first = text.split(",", 1)
        return fold(first), fold(last)
    words = fold(text.replace("-", "\x00")).split() if "-" not in text else None
    if words is None:  # double names stay together
        head, _, tail = re.sub(r"[^\w\-]+", " ", text).strip().partition(" ")
        return fold(head), fold(tail)
    return (words[0], " ".join(words[1:])) if words else ("", "")


def attributes(kind: int, document: dict) -> dict[str, str | None]:
    """The comparable attributes of one document; what isn't known is None."""

    def at(path: str):
        value = document
        for name in path.split("."):
            value = value.get(name) if isinstance(value, dict) else None
        return value if known(value) and not isinstance(value, (dict, list)) else None

    raw = {name: text_of(at(path)) for name, path in PATHS[kind].items()}
    out: dict[str, str | None] = dict.fromkeys(ATTRIBUTES)
    if raw.get("name"):
        out["first"], out["last"] = split_name(raw["name"])
    for name in ("first", "last"):
        if raw.get(name):
            out[name] = fold(raw[name])
    if raw.get("address"):
        zips = re.findall(r"\b\d{5}\b", raw["address"])
        out["zip"] = zips[-1] if zips and zips[-1] != "00000" else None
        raw["street"] = re.split(r"\b\d{5}\b", raw["address"])[0] if zips else None
    if raw.get("zip"):
        out["zip"] = re.sub(r"\D", "", raw["zip"]) or None
    if raw.get("street"):
        out["street"] = fold(raw["street"]).replace(" ", "").replace("strasse", "str")
    if raw.get("birth"):
        out["birth"] = birth_date(raw["birth"])
    if raw.get("sex"):
        out["sex"] = SEXES.get(plain(raw["sex"]))
    if raw.get("phone"):
        out["phone"] = phone_number(raw["phone"])
    if raw.get("email"):
        out["email"] = fold(raw["email"]).replace(" ", "")
    out["number"] = plain(raw["number"]) if raw.get("number") else None
    return {k: v or None for k, v in out.items()}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "project_id", "updated", "record", *ATTRIBUTES]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), *[pa.string()] * len(ATTRIBUTES)]
    for batch in batches:
        out: list[tuple] = []
        for i, project, kind, updated, text in zip(*(c.to_pylist() for c in batch.columns)):
            document = parse(text)
            if document is None:
                continue
            a = attributes(kind, document)
            record = digest(project, kind, a["number"]) if a["number"] else digest(project, kind, "", canonical(document))
            out.append((i, project, updated, record, *(a[name] for name in ATTRIBUTES)))
        columns = list(zip(*out)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def person_rows(instances: DataFrame) -> DataFrame:
    """One row per document that describes a person: id, project, ``record`` (the same for all rows of one record
    number of a project) and the attributes. Other types, null data and what isn't one JSON object give no row."""
    rows = instances.where(F.col("entity_type_id").isin(list(PATHS))).where("data is not null and project_id is not null")
    base = rows.select(F.col("id").cast("long").alias("id"), F.col("project_id").cast("int").alias("project_id"), F.col("entity_type_id").cast("int").alias("kind"), F.coalesce(F.unix_micros("updated_at"), F.lit(-(2**63))).alias("updated"), "data")
    return base.mapInArrow(_read, "id bigint, project_id int, updated bigint, record binary, " + ", ".join(f"`{a}` string" for a in ATTRIBUTES))
