"""Searches: conjunctions of case-insensitive patterns, full-text predicates, top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.functions.fulltext import json_text, lexemes, may_hold, prefix_matches, rank, similarity, word_matches


def parts(query: str) -> list[str]:
    return query.split()


def _any(columns: list[str], part: str) -> Column:
    """Some column contains the part, case ignored; % and _ in it are wildcards."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string").ilike(f"%{part}%"), F.lit(False)) for c in columns])


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def pseudonyms(rows: DataFrame, query: str, domain_id: int, as_of: Column, most: int | None = 500) -> DataFrame:
    """Pseudonyms of a domain valid at ``as_of`` that contain every part of the query in identifier, type or
    pseudonym, ordered by identifier and type; ``*`` finds all, at most ``most``."""
    valid = rows.where((F.col("domainid") == domain_id) & (F.col("validfrom") <= as_of) & (as_of < F.col("validto")))
    if query.strip() == "*":
        ordered = valid.orderBy(F.col("identifier").asc_nulls_last(), F.col("idtype").asc_nulls_last(), "id")
        return ordered.limit(most) if most else ordered
    found = valid.where(_all([_any(["identifier", "idtype", "pseudonym"], p) for p in parts(query)]))
    return found.orderBy(F.col("identifier").asc_nulls_last(), F.col("idtype").asc_nulls_last(), "id")


def truncated(found: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """At most ``most`` rows, and whether there were more."""
    return found.limit(most), found.limit(most + 1).count() > most


def domains(rows: DataFrame, query: str, visible: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Domains whose name, prefix or description contains the query literally, case ignored; ordered by name.

    ``visible`` (id) restricts to permitted domains before the limit.
    """
    text = query.strip().lower()
    found = rows if text == "*" else rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(text)), F.lit(False)) for c in ("name", "prefix", "description")]))
    if visible is not None:
        found = found.join(visible.select("id").distinct(), "id", "left_semi")
    found = found.orderBy("name", "id")
    return found.limit(most) if most else found


def instances(rows: DataFrame, query: str, type_id: int | None = None, most: int | None = 100) -> DataFrame:
    """Live instances that fit every part of the query: in uid, project, type or times as text, as the beginning of a
    lexeme of the document, or (three signs and more) anywhere in its text. Best first: more of the query's words, then
    greater trigram similarity, then id. ``*`` finds the latest. ``most`` None: all."""
    live = rows.where("not is_deleted")
    if type_id is not None:
        live = live.where(F.col("entity_type_id") == type_id)
    if query.strip() == "*":
        latest = live.orderBy(F.col("updated_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "instance_uid")
        return latest.limit(most) if most else latest
    words = lexemes(json_text(F.col("data")))
    tests = []
    for part in parts(query):
        test = _any(["instance_uid", "project_id", "entity_type_id", "created_at", "updated_at", *["data"] * (len(part) >= 3)], part)
        # in this order: a document is read only where nothing else fits and its text doesn't rule it out
        tests.append(test | F.coalesce(may_hold(F.col("data"), part) & prefix_matches(words, part), F.lit(False)))
    found = live.where(_all(tests))
    ranked = found.withColumn("_rank", F.coalesce(rank(words, query), F.lit(0.0))).withColumn("_like", similarity(F.col("data"), F.lit(query))).orderBy(F.col("_rank").desc(), F.col("_like").desc(), "id")
    return ranked.limit(most) if most else ranked


def types(rows: DataFrame, query: str, project_id: int | None) -> DataFrame:
    """Types that aren't deprecated, of the project (or base types for None), that fit every part of the query in
    name or version or by words of the definition; ordered by name and version."""
    scope = (F.col("project_id") == project_id) if project_id is not None else (F.col("project_id").isNull() & F.col("is_base_type"))
    words = lexemes(json_text(F.col("type_definition")))
    found = rows.where(~F.col("is_deprecated") & scope).where(_all([_any(["name", "version"], p) | F.coalesce(word_matches(words, p), F.lit(False)) for p in parts(query)]))
    return found.orderBy("name", "version", "id")


def contains_json(rows: DataFrame, wanted: dict[str, object], data: str = "data", most: int | None = None) -> DataFrame:
    """Rows whose document has every wanted scalar under its dotted path, compared as JSON (type and value)."""

    def test(path: str, value: object) -> Column:
        v = F.try_parse_json(F.col(data))
        kind = {str: "string", bool: "boolean", int: "bigint", float: "double"}[type(value)]
        return F.coalesce(F.try_variant_get(v, f"$.{path}", kind) == F.lit(value), F.lit(False)) & F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")) == {"string": "STRING", "boolean": "BOOLEAN", "bigint": "BIGINT", "double": "DOUBLE"}[kind], F.lit(kind == "double"))

    found = rows.where(_all([test(k, v) for k, v in wanted.items()]))
    return found.orderBy("id").limit(most) if most else found
