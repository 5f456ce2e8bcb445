"""User-defined type definitions: validation, derived schemas, checks of instances, specialisation."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from veilframe.functions.jsondoc import parse

LEAF_TYPES = {"string", "integer", "number", "boolean", "date", "datetime", "enum"}
SPARK_TYPES = {"string": T.StringType(), "enum": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampType()}
_NUMERIC, _TEXTUAL = ("minimum", "maximum"), ("minLength", "maxLength", "pattern")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_DATETIME = re.compile(r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})")


def is_container(node: Mapping[str, Any]) -> bool:
    return "attributes" in node


def is_named_group(node: Mapping[str, Any]) -> bool:
    return is_container(node) and str(node.get("layout", "")).lower() == "group" and bool(str(node.get("name") or "").strip())


def joined(path: str, name: str) -> str:
    return f"{path}.{name}" if path else name


def kind_of(node: Mapping[str, Any]) -> str:
    """The type of a leaf; an enum is a string."""
    kind = str(node.get("type", "")).lower()
    return "string" if kind == "enum" else kind


def allowed_values(node: Mapping[str, Any]) -> list[Any] | None:
    """``values``, else ``enum``, of a leaf."""
    for name in ("values", "enum"):
        if isinstance(node.get(name), list):
            return node[name]
    return None


def leaves(definition: Mapping[str, Any] | None) -> dict[str, Mapping[str, Any]]:
    """Leaf attributes by dotted path; only named groups add to the path."""

    def walk(nodes: Any, path: str) -> Iterator[tuple[str, Mapping[str, Any]]]:
        for node in nodes if isinstance(nodes, list) else []:
            if is_container(node):
                yield from walk(node["attributes"], joined(path, node["name"]) if is_named_group(node) else path)
            else:
                yield joined(path, node["name"]), node

    return dict(walk((definition or {}).get("attributes"), ""))


def definition_errors(definition: Mapping[str, Any]) -> list[str]:
    """What is wrong with a definition: shape, double paths, constraints that don't suit the type."""
    errors: list[str] = []
    seen: set[str] = set()

    def misplaced(node: Mapping[str, Any], names: tuple[str, ...], place: str, path: str) -> None:
        errors.extend(f"{n} is only valid for {place} ({path})" for n in names if n in node)

    def leaf(node: Mapping[str, Any], path: str) -> None:
        kind = str(node.get("type", "")).lower()
        if path in seen:
            errors.append(f"path {path} occurs twice")
        seen.add(path)
        if kind not in LEAF_TYPES:
            errors.append(f"unknown type {kind!r} ({path})")
        elif kind == "enum":
            if not allowed_values(node):
                errors.append(f"an enum needs values ({path})")
            misplaced(node, _NUMERIC, "numbers", path)
            misplaced(node, _TEXTUAL, "strings", path)
            return
        elif "values" in node:
            errors.append(f"values are only valid for an enum ({path})")
        if kind != "string":
            misplaced(node, _TEXTUAL, "strings", path)
        if kind not in ("integer", "number"):
            misplaced(node, _NUMERIC, "numbers", path)
        for low, high in (("minLength", "maxLength"), ("minimum", "maximum")):
            if low in node and high in node and node[low] > node[high]:
                errors.append(f"{low} must not exceed {high} ({path})")

    def walk(nodes: Any, path: str) -> None:
        if not isinstance(nodes, list) or not nodes:
            errors.append(f"attributes must be a filled list ({path or 'root'})")
            return
        for node in nodes:
            if not isinstance(node, dict):
                errors.append(f"an attribute must be an object ({path or 'root'})")
            elif is_container(node):
                layout, name = str(node.get("layout", "")).lower(), str(node.get("name") or "").strip()
                if layout not in ("row", "col", "group"):
                    errors.append(f"unknown layout {layout!r} ({path or 'root'})")
                if layout in ("row", "col") and name:
                    errors.append(f"a {layout} must not have a name ({name})")
                if node.get("repeatable") and not (layout == "group" and name):
                    errors.append("only named groups and leaves may be repeatable")
                inside = path
                if is_named_group(node):
                    inside = joined(path, name)
                    if inside in seen:
                        errors.append(f"path {inside} occurs twice")
                    seen.add(inside)
                walk(node["attributes"], inside)
            elif not str(node.get("name") or "").strip():
                errors.append(f"an attribute needs a name ({path or 'root'})")
            else:
                leaf(node, joined(path, node["name"]))

    walk(definition.get("attributes"), "")
    return errors


def specialisation_errors(base: Mapping[str, Any], project: Mapping[str, Any]) -> list[str]:
    """Where a project's definition isn't a specialisation of its base: every base attribute must be there, with the
    same type, repeatability and pattern, and nothing may be loosened."""
    own, needed = leaves(project), leaves(base)
    errors = [f"{p} is missing" for p in sorted(needed) if p not in own]
    if errors:
        return errors
    for path in sorted(needed):
        b, p = needed[path], own[path]
        if kind_of(b) != kind_of(p):
            errors.append(f"{path} changes its type from {kind_of(b)} to {kind_of(p)}")
            continue
        if bool(b.get("repeatable")) != bool(p.get("repeatable")):
            errors.append(f"{path} changes whether it is repeatable")
        errors += [f"{path} must stay {what}" for what in ("required", "linkage") if b.get(what) and not p.get(what)]
        if not set(b.get("tags") or []) <= set(p.get("tags", b.get("tags")) or []):
            errors.append(f"{path} must keep its tags")
        for name, looser in (("minimum", -1), ("minLength", -1), ("maximum", 1), ("maxLength", 1)):
            if name in b and (name not in p or (p[name] - b[name]) * looser > 0):
                errors.append(f"{path} must not loosen {name}")
        if "pattern" in b and p.get("pattern") != b["pattern"]:
            errors.append(f"{path} must keep its pattern")
        if (values := allowed_values(b)) is not None and not (allowed_values(p) is not None and set(map(str, allowed_values(p))) <= set(map(str, values))):
            errors.append(f"{path} must keep its values or restrict them")
    return errors


def spark_schema(definition: Mapping[str, Any]) -> T.StructType:
    """The schema that instances of the type have: named groups are structs, what is repeatable an array."""

    def fields(nodes: Any) -> list[T.StructField]:
        out: list[T.StructField] = []
        for node in nodes or []:
            if is_container(node):
                inner = fields(node["attributes"])
                if not is_named_group(node):
                    out += inner
                    continue
                kind: T.DataType = T.StructType(inner)
            else:
                kind = SPARK_TYPES[str(node["type"]).lower()]
            out.append(T.StructField(node["name"], T.ArrayType(kind) if node.get("repeatable") else kind, True))
        return out

    return T.StructType(fields(definition.get("attributes")))


@dataclass(frozen=True)
class Shape:
    """What an object of a type may and must hold; compiled once per type."""

    fields: dict[str, tuple[Any, bool]] = field(default_factory=dict)
    required: tuple[str, ...] = ()


def compiled(definition: Mapping[str, Any]) -> Shape:
    def shape(nodes: Any) -> Shape:
        found: dict[str, tuple[Any, bool]] = {}
        required: list[str] = []
        for node in nodes or []:
            if is_container(node):
                inner = shape(node["attributes"])
                if is_named_group(node):
                    found[node["name"]] = (inner, bool(node.get("repeatable")))
                else:
                    found.update(inner.fields)
                    required += inner.required
            else:
                found[node["name"]] = (node, bool(node.get("repeatable")))
                if node.get("required"):
                    required.append(node["name"])
        return Shape(found, tuple(required))

    return shape(definition.get("attributes"))


def _scalar_errors(node: Mapping[str, Any], value: Any, path: str) -> list[str]:
    kind = str(node["type"]).lower()
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    right = {"integer": number and float(value).is_integer(), "number": number, "boolean": isinstance(value, bool)} if number or kind in ("integer", "number", "boolean") else {}
    if not (right.get(kind, False) if kind in ("integer", "number", "boolean") else isinstance(value, str)):
        return [f"{path}: not of type {kind}"]
    errors = []
    if kind == "date" and not (_DATE.fullmatch(value) and _real_date(value)):
        errors.append(f"{path}: no date")
    if kind == "datetime" and not (_DATETIME.fullmatch(value) and _real_date(value[:10])):
        errors.append(f"{path}: no date and time")
    values = allowed_values(node)
    if values is not None and value not in values:
        errors.append(f"{path}: not an allowed value")
    if number:
        errors += [f"{path}: below {node['minimum']}"] if "minimum" in node and value < node["minimum"] else []
        errors += [f"{path}: above {node['maximum']}"] if "maximum" in node and value > node["maximum"] else []
    if isinstance(value, str):
        errors += [f"{path}: shorter than {node['minLength']}"] if len(value) < node.get("minLength", 0) else []
        errors += [f"{path}: longer than {node['maxLength']}"] if "maxLength" in node and len(value) > node["maxLength"] else []
        errors += [f"{path}: not of the pattern"] if "pattern" in node and not re.search(node["pattern"], value) else []
    return errors


def _real_date(text: str) -> bool:
    import datetime

    try:
        datetime.date.fromisoformat(text)
    except ValueError:
        return False
    return True


def instance_errors(shape: Shape, value: Any, path: str = "$") -> list[str]:
    """Messages on everything in a document that its type doesn't allow; objects are closed."""
    if not isinstance(value, dict):
        return [f"{path}: not an object"]
    errors = [f"{path}.{name}: missing" for name in shape.required if name not in value]
    for name, item in value.items():
        at = f"{path}.{name}"
        if name not in shape.fields:
            errors.append(f"{at}: unknown")
            continue
        node, repeatable = shape.fields[name]
        one = (lambda v, p, n=node: instance_errors(n, v, p)) if isinstance(node, Shape) else (lambda v, p, n=node: _scalar_errors(n, v, p))
        if not repeatable:
            errors += one(item, at)
        elif not isinstance(item, list):
            errors.append(f"{at}: not an array")
        else:
            for k, element in enumerate(item):
                errors += one(element, f"{at}[{k}]")
    return errors


def validate(instances: DataFrame, types: DataFrame, row_id: str = "id", type_id: str = "entity_type_id", data: str = "data") -> DataFrame:
    """``id`` and ``errors`` of every instance: empty if it fits its type. Null data and what is no JSON object, and
    an unknown type, are errors. The types (configuration) are compiled once and sent along."""
    shapes = {int(r[0]): compiled(json.loads(r[1])) for r in types.select("id", "type_definition").where("type_definition is not null").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for kind, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                document = parse(text)
                found.append(["$: no JSON object"] if document is None else ["$: unknown type"] if kind not in shapes else instance_errors(shapes[kind], document))
            found = [[e.encode("utf-8", "replace").decode() for e in some] for some in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["id", "errors"])

    return instances.select(F.col(row_id).cast("long"), F.col(type_id).cast("int"), F.col(data)).mapInArrow(run, "id bigint, errors array<string>")


def top_level_errors(instances: DataFrame, definition: Mapping[str, Any], data: str = "data") -> DataFrame:
    """The part of validation that needs no Python: ``id`` with unknown and missing names of the top level."""
    shape = compiled(definition)
    keys = F.json_object_keys(data)
    names = lambda some: F.array(*map(F.lit, some)).cast("array<string>")
    return instances.select("id", F.array_sort(F.array_except(keys, names(shape.fields))).alias("unknown"), F.array_sort(F.array_except(names(shape.required), keys)).alias("missing"))
