"""Strict JSON documents, the plain form of texts, and stand-ins for unknown values."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b
from typing import Any

#: What stands for "not known", in plain form. Signs alone ("-", "--", "?") have an empty plain form.
UNKNOWN_WORDS = frozenset({"na", "ka", "unknown", "unbekannt", "nichtbekannt", "keineangabe", "notknown"})
#: A postcode and a birth date (year first, day first) that stand for "not known", in plain form.
UNKNOWN_CODES = frozenset({"00000", "19000101", "01011900"})


class _Dropped(dict):
    """Translation table that deletes white space and punctuation of any kind, filled as characters are met."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = None if c.isspace() or unicodedata.category(c)[0] == "P" else code
        return self[code]


_DROPPED = _Dropped()


def plain(text: str) -> str:
    """The text without white space, letter case and punctuation."""
    return text.translate(_DROPPED).casefold()


class Number(str):
    """A JSON number as it is written."""


def _refuse(name: str) -> Any:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_refuse)
_EXACT = json.JSONDecoder(parse_constant=_refuse, parse_int=Number, parse_float=Number)


def parse(text: str | None, exact: bool = False) -> dict | None:
    """The one complete JSON object in ``text`` with nothing but white space around it, else None.

    ``exact`` keeps numbers as written. Of repeated names in an object the last counts. Documents nested too deep for
    the parser count as no JSON.
    """
    if not text:
        return None
    try:
        value = (_EXACT if exact else _DECODER).decode(text.strip(" \t\r\n"))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def parse_any(text: str) -> Any:
    """Any complete JSON value, None if there is none."""
    try:
        return _DECODER.decode(text.strip(" \t\r\n"))
    except (ValueError, RecursionError):
        return None


def canonical(value: Any) -> str:
    """One text for all writings of a value: names sorted, texts in plain form, numbers as written."""
    if isinstance(value, Number):
        return value
    if isinstance(value, str):
        return json.dumps(plain(value))
    if isinstance(value, dict):
        return "{" + ",".join([json.dumps(k) + ":" + canonical(value[k]) for k in sorted(value)]) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return "null" if value is None else "true" if value else "false"


def digest(*parts: object) -> bytes:
    """128 bits of a fingerprint of the parts; safe as a key for any number of rows met in practice."""
    return blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def known(value: Any) -> bool:
    """Whether a scalar says something: not null, blank, or a stand-in for "not known"."""
    if value is None:
        return False
    if not isinstance(value, str):
        return True
    p = plain(value)
    return bool(p) and p not in UNKNOWN_WORDS and p not in UNKNOWN_CODES


def repeatable_groups(attributes: list) -> dict[str, tuple[bool, dict]]:
    """Named groups of a type definition: name -> (repeatable, groups within). Other containers are layout only."""
    found: dict[str, tuple[bool, dict]] = {}
    for a in attributes or []:
        if not isinstance(a, dict) or "attributes" not in a:
            continue
        inner = repeatable_groups(a["attributes"])
        if a.get("layout") == "group" and a.get("name"):
            found[a["name"]] = (bool(a.get("repeatable")), inner)
        else:
            found.update(inner)
    return found


def fields_of(attributes: list, path: str = "", element: str = "", prefix: str = "") -> Iterator[tuple[str, str, bool]]:
    """(group, field, whether it is repeatable) of every attribute within a repeatable group; a field in a plain group
    within an element belongs to the element and has a dotted name."""
    for a in attributes or []:
        if not isinstance(a, dict):
            continue
        if "attributes" not in a:
            if element and a.get("name"):
                yield element, prefix + a["name"], bool(a.get("repeatable"))
        elif a.get("layout") == "group" and a.get("name"):
            inside = f"{path}.{a['name']}" if path else a["name"]
            if a.get("repeatable"):
                yield from fields_of(a["attributes"], inside, inside, "")
            else:
                yield from fields_of(a["attributes"], inside, element, f"{prefix}{a['name']}." if element else "")
        else:
            yield from fields_of(a["attributes"], path, element, prefix)


def definitions(rows: list[tuple[int, str | None]]) -> dict[int, dict[str, tuple[bool, dict]]]:
    """Type id -> its groups; a type without a readable definition has none."""
    return {int(i): repeatable_groups((parse(text) or {}).get("attributes", [])) for i, text in rows if i is not None}


def text_of(value: Any) -> str | None:
    """A scalar as text: strings as they are, numbers and booleans as in JSON."""
    if value is None:
        return None
    return value if isinstance(value, str) else json.dumps(value)


def clean(text: str | None) -> str | None:
    """The text with lone surrogates, which no column can hold, replaced."""
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def scalars(document: dict, groups: dict[str, tuple[bool, dict]], path: str = "") -> Iterator[tuple[str, Any]]:
    """Dotted path and value of each scalar outside repeatable groups and arrays."""
    for name, value in document.items():
        repeatable, inner = groups.get(name, (False, {}))
        if repeatable or isinstance(value, list):
            continue
        if isinstance(value, dict):
            yield from scalars(value, inner, f"{path}{name}.")
        else:
            yield path + name, value
