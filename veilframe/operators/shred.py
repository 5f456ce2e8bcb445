"""Deeply nested documents as an adjacency table of nodes, and flat tables made from it by join and pivot."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilframe.functions.jsondoc import clean, definitions, fields_of, parse, parse_any, text_of
from veilframe.plans.durable import durable, release

#: grp: name path of the repeatable group whose element a node is ("encounters.labs"), null for other nodes.
#: owner: the nearest element (or the document) a scalar or item hangs below, over plain objects and arrays.
#: field: dotted name path from the owner; null for nodes that aren't scalars, items or arrays.
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
_COLUMNS = [("id", "bigint"), ("type_id", "int"), ("node", "int"), ("parent", "int"), ("owner", "int"), ("label", "string"), ("field", "string"), ("ordinal", "int"), ("kind", "string"), ("scalar", "string"), ("grp", "string"), ("path", "string")]
NODE_SCHEMA = ", ".join(f"{n} {t}" for n, t in _COLUMNS)
_ARROW = pa.schema([(n, _KINDS[t]) for n, t in _COLUMNS])
#: Nodes that a batch holds before it is handed on; a document's nodes may be spread over several batches.
_BATCH = 50_000


class _Shredder:
    """Numbers the nodes of one document in document order and writes them to ``out``."""

    def __init__(self, out: list[tuple]) -> None:
        self.out = out

    def document(self, row_id: int, type_id: int | None, value: dict, groups: dict) -> None:
        self.row_id, self.type_id, self.next = row_id, type_id, 0
        root = self._node(None, None, None, None, None, "object", None, None, "")
        self._object(value, groups, root, root, "", "", "")

    def _node(self, parent: int | None, owner: int | None, label: str | None, field: str | None, ordinal: int | None, kind: str, scalar: str | None, group: str | None, path: str | None) -> int:
        node = self.next
        self.next += 1
        self.out.append((self.row_id, self.type_id, node, parent, owner, clean(label), clean(field), ordinal, kind, clean(scalar), clean(group), clean(path)))
        return node

    def _object(self, value: dict, groups: dict, node: int, owner: int, path: str, group: str, field: str) -> None:
        for name, child in value.items():
            known = groups.get(name)
            at, inside = (f"{path}.{name}", f"{group}.{name}") if path else (name, f"{group}.{name}" if group else name)
            below = f"{field}.{name}" if field else name
            if known is not None and known[0]:
                self._elements(child, known[1], name, owner, at, inside)
            elif isinstance(child, dict):
                self._object(child, known[1] if known else {}, self._node(node, owner, name, None, None, "object", None, None, at), owner, at, inside, below)
            elif isinstance(child, list):
                self._array(child, node, owner, name, at, below)
            else:
                self._node(node, owner, name, below, None, "scalar", text_of(child), None, None)

    def _elements(self, value: Any, inner: dict, name: str, owner: int, path: str, group: str) -> None:
        if isinstance(value, str):  # the group may be stored as text
            value = parse_any(value)
        items = value if isinstance(value, list) else [value]
        for k, item in enumerate(items):
            if isinstance(item, dict):
                at = f"{path}[{k}]"
                node = self._node(owner, owner, name, None, k, "element", None, group, at)
                self._object(item, inner, node, node, at, group, "")

    def _array(self, value: list, parent: int, owner: int, name: str, path: str, field: str) -> None:
        array = self._node(parent, owner, name, field, None, "array", None, None, path)
        for k, item in enumerate(value):
            at, below = f"{path}[{k}]", f"{field}[{k}]"
            if isinstance(item, dict):
                self._object(item, {}, self._node(array, owner, name, None, k, "object", None, None, at), owner, at, "", below)
            elif isinstance(item, list):
                self._array(item, array, owner, name, at, below)
            else:
                self._node(array, owner, name, field, k, "item", text_of(item), None, None)


def nodes(instances: DataFrame, types: DataFrame, row_id: str = "id", type_id: str = "entity_type_id", data: str = "data") -> DataFrame:
    """Shreds every document into its nodes (see ``NODE_SCHEMA``).

    Node 0 is the document itself. Elements of repeatable groups (kind ``element``) have the nearest enclosing
    element, or the document, as parent, whether the group is stored as an array, a lone object (ordinal 0) or JSON
    text; null elements keep their position and make no node. Plain objects, arrays, their scalar items and all other
    scalars are nodes too. Rows whose data is null or not exactly one JSON object give no node; rows of an unknown type
    have no repeatable groups. ``types`` (id, type_definition) is configuration: one row per entity type.
    """
    known = definitions([(r[0], r[1]) for r in types.select("id", "type_definition").collect()])

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            shredder = _Shredder(out)
            for i, t, text in zip(*(c.to_pylist() for c in batch.columns)):
                document = parse(text)
                if document is not None:
                    shredder.document(i, t, document, known.get(t, {}))
                if len(out) > _BATCH:
                    yield _batch(out)
                    out.clear()
            yield _batch(out)

    return instances.select(F.col(row_id).cast("long"), F.col(type_id).cast("int"), F.col(data)).where(F.col(data).isNotNull()).mapInArrow(shred, NODE_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def elements(node_table: DataFrame) -> DataFrame:
    """The element nodes: instance, path, group, parent and position."""
    return node_table.where("kind = 'element'")


def columns_of(types: DataFrame, group: str | None = None) -> tuple[list[str], list[str]]:
    """Fields and repeatable attributes that the types (configuration) define within repeatable groups, or within
    ``group``, by name. A name that is repeatable anywhere counts as repeatable everywhere."""
    found = [f for r in types.select("type_definition").collect() for f in fields_of((parse(r[0]) or {}).get("attributes", []))]
    lists = {name for _, name, repeatable in found if repeatable}
    names = {name for g, name, _ in found if group is None or g == group}
    return sorted(names - lists), sorted(names & lists)


def entity_tables(node_table: DataFrame, types: DataFrame) -> DataFrame:
    """The flat tables of all groups in one, told apart by ``grp``: ``id``, ``node``, ``parent`` (the ``node`` of the
    parent group's row, 0 for the document), ``ordinal``, ``path``, one text column per field that a type defines and
    one array column per repeatable attribute (``f0``, ``f1``, ... in the order of ``columns_of``, so that no name of a
    field can clash with another column).

    The adjacency table is joined with itself: element nodes with the scalars and items they own, which are pivoted
    under their owner first, so that one shuffle on (instance, node) serves pivot and join. A field that is absent, or
    isn't scalar, is null; items keep their order, a lone scalar is an array of one, an empty array stays empty.
    Elements without any scalar have a row of nulls.
    """
    fields, lists = columns_of(types)
    own = node_table.where("kind = 'element'").select("id", "node", "parent", "ordinal", "path", "grp")
    # scalars right below the document belong to no element
    parts = node_table.where("owner > 0").where(F.col("kind").isin("scalar", "item", "array") & F.col("field").isin([*fields, *lists]))
    kind, item = F.col("kind"), F.struct(F.coalesce("ordinal", F.lit(0)).alias("k"), F.col("scalar").alias("v"))
    lone = (kind == "scalar") & F.col("scalar").isNotNull()
    columns = []
    for k, name in enumerate([*fields, *lists]):
        here = F.col("field") == name
        if name in lists:
            items = F.collect_list(F.when(here & ((kind == "item") | lone), item))
            columns.append(F.when(F.max(F.when(here & ((kind == "array") | lone), F.lit(1))).isNotNull(), F.transform(F.array_sort(items), lambda x: x["v"])).alias(f"f{k}"))
        else:
            columns.append(F.max(F.when(here & (kind == "scalar"), F.col("scalar"))).alias(f"f{k}"))
    if not columns:
        return own
    wide = parts.groupBy("id", F.col("owner").alias("node")).agg(*columns)
    return own.join(wide, ["id", "node"], "left")


def flat_table(tables: DataFrame, types: DataFrame, group: str) -> DataFrame:
    """The flat table of one group out of ``entity_tables``: ``id``, ``node``, ``parent``, ``ordinal``, ``path`` and the
    group's fields and repeatable attributes under their names."""
    fields, lists = columns_of(types)
    place = {name: f"f{k}" for k, name in enumerate([*fields, *lists])}
    own = [name for some in columns_of(types, group) for name in some]
    return tables.where(F.col("grp") == group).select("id", "node", "parent", "ordinal", "path", *[F.col(place[name]).alias(name) for name in own])


def shredded(instances: DataFrame, types: DataFrame, row_id: str = "id", type_id: str = "entity_type_id", data: str = "data") -> DataFrame:
    """The flat tables of all groups, written out by way of the written adjacency table."""
    table = durable(nodes(instances, types, row_id, type_id, data))
    tables = durable(entity_tables(table, types))
    release(table)
    return tables
