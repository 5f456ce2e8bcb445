"""The forest of domains: subtrees, roots, paths, inheritance."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.plans.durable import durable, release


def ancestors(domains: DataFrame) -> DataFrame:
    """Every domain with each of its ancestors and itself: ``id``, ``ancestor``, ``distance``, at any depth.

    Ways double in length each round, so a tree of depth d takes log2(d) joins; every round is written out. A parent
    that isn't there ends the way like a missing one; domains that are their own ancestors raise ``ValueError``.
    """
    known = domains.where("id is not null").select("id").distinct()
    kind = domains.schema["id"].dataType
    there = known.select(F.col("id").alias("ancestor"))
    jumps = durable(domains.where("id is not null").select("id", F.col("superdomainid").cast(kind).alias("ancestor")).join(there, "ancestor", "left_semi").select("id", "ancestor").distinct())
    found = known.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    length, most = 1, None
    while not jumps.isEmpty():
        most = known.count() if most is None else most
        if length > most:
            raise ValueError("some domains are their own ancestors")
        onward = found.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("_next"), (F.col("distance") + length).alias("distance"))
        further = jumps.join(onward, "ancestor").select("id", F.col("_next").alias("ancestor"), "distance")
        last, found = found, durable(found.unionByName(further))
        twice = jumps.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("_next"))
        before, jumps = jumps, durable(jumps.join(twice, "ancestor").select("id", F.col("_next").alias("ancestor")))
        release(last, before)
        length *= 2
    release(jumps)
    return found


def _start(domains: DataFrame, name: str) -> DataFrame:
    """``ancestor``: the id of the domain of this name, trimmed, case ignored; the name is a value, never SQL text."""
    return domains.where(F.lower("name") == F.lit(name.strip().lower())).select(F.col("id").alias("ancestor"))


def subtree(domains: DataFrame, name: str) -> DataFrame:
    """The domain of this name (trimmed, case ignored) and all below it: ``id``, ``name``, ``superdomainid``,
    ``depth``."""
    below = ancestors(domains).join(_start(domains, name), "ancestor", "left_semi").select("id", F.col("distance").alias("depth"))
    return domains.select("id", "name", "superdomainid").join(below, "id")


def roots(domains: DataFrame) -> DataFrame:
    """Every domain with the root of its tree: ``id``, ``root``."""
    up = ancestors(domains)
    return up.groupBy("id").agg(F.max_by("ancestor", "distance").alias("root"))


def whole_tree(domains: DataFrame, name: str) -> DataFrame:
    """All domains of the tree that the named one belongs to."""
    root = roots(domains)
    here = domains.where(F.lower("name") == F.lit(name.strip().lower())).select("id").join(root, "id").select("root")
    return domains.join(root.join(here, "root", "left_semi").select("id"), "id", "left_semi")


def flat_names(domains: DataFrame, name: str) -> DataFrame:
    """Names of the whole tree, sorted."""
    return whole_tree(domains, name).select("name").orderBy("name")


def hierarchy(domains: DataFrame) -> DataFrame:
    """Every domain with its depth and the path of names from its root; a domain whose parent is missing is a root."""
    names = domains.select(F.col("id").alias("ancestor"), F.col("name").alias("_name"))
    line = ancestors(domains).join(names, "ancestor").groupBy("id").agg(F.max("distance").alias("depth"), F.sort_array(F.collect_list(F.struct("distance", "_name")), asc=False).alias("l"))
    return domains.select("id", "name").join(line, "id").select("id", "name", "depth", F.array_join(F.transform("l", lambda x: x["_name"]), "/").alias("path"))


def paths(domains: DataFrame, pairs: DataFrame) -> DataFrame:
    """The way through the tree between pairs of domains (``source``, ``target`` ids): ``path``, ids from source up to
    the lowest common ancestor and down to the target; empty in different trees, null for an unknown domain."""
    up = ancestors(domains)
    a = up.select(F.col("id").alias("source"), "ancestor", F.col("distance").alias("da"))
    b = up.select(F.col("id").alias("target"), "ancestor", F.col("distance").alias("db"))
    lists = up.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("distance", "ancestor"))), lambda x: x["ancestor"]).alias("line"))
    meet = pairs.join(a, "source").join(b, ["target", "ancestor"]).groupBy("source", "target").agg(F.min(F.struct("da", "db")).alias("m"))
    la, lb = lists.select(F.col("id").alias("source"), F.col("line").alias("la")), lists.select(F.col("id").alias("target"), F.col("line").alias("lb"))
    found = pairs.join(la, "source", "left").join(lb, "target", "left").join(meet, ["source", "target"], "left")
    way = F.concat(F.slice("la", F.lit(1), F.col("m.da") + 1), F.reverse(F.slice("lb", F.lit(1), F.greatest(F.col("m.db"), F.lit(0)))))
    return found.select("source", "target", F.when(F.col("la").isNull() | F.col("lb").isNull(), None).when(F.col("m").isNull(), F.array().cast("array<int>")).otherwise(way).alias("path"))


def path_names(domains: Sequence[tuple[int, str, int | None]], source: str, target: str) -> list[str] | None:
    """The same way by depth-first search over collected domains (id, name, parent): children first, then the parent.
    Empty if there is no way, None for an unknown name; names are compared as written."""
    by_name = {name: (i, parent) for i, name, parent in domains}
    if source not in by_name or target not in by_name:
        return None
    names = {i: name for i, name, _ in domains}
    children: dict[int | None, list[int]] = {}
    for i, _, parent in domains:
        children.setdefault(parent, []).append(i)
    parents = {i: parent for i, _, parent in domains}
    stack: list[list[int]] = [[by_name[source][0]]]
    while stack:
        way = stack.pop()
        if names[way[-1]] == target:
            return [names[i] for i in way]
        onward = [*children.get(way[-1], []), *([parents[way[-1]]] if parents[way[-1]] in names else [])]
        stack += [[*way, i] for i in reversed(onward) if i not in way]
    return []


def nested(domains: Sequence[tuple[int, str, int | None]]) -> list[dict[str, Any]]:
    """Collected domains as nested objects with ``children``, roots and children sorted by name; orphans are roots."""
    nodes = {i: {"id": i, "name": name, "children": []} for i, name, _ in domains}
    top = []
    for i, _, parent in domains:
        (nodes[parent]["children"] if parent in nodes and parent != i else top).append(nodes[i])
    for node in nodes.values():
        node["children"].sort(key=lambda n: n["name"])
    return sorted(top, key=lambda n: n["name"])


def inherit_at_creation(requests: DataFrame, domains: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """New domains (``name``, ``parent`` id and given properties) completed: each property as given, else the parent's,
    else the default, with ``<property>inherited`` telling that it wasn't given but has a parent to come from."""
    properties = list(defaults)
    parents = domains.select(F.col("id").alias("parent"), *[F.col(p).alias(f"_{p}") for p in properties]).withColumn("_found", F.lit(True))
    joined = requests.join(parents, "parent", "left")
    columns = []
    for p, default in defaults.items():
        columns += [F.coalesce(F.col(p), F.col(f"_{p}"), default).alias(p), (F.col(p).isNull() & F.col("_found").isNotNull()).alias(f"{p}inherited")]
    return joined.select("name", "parent", *columns)


def cascade(domains: DataFrame, property: str, changed: dict[int, Any]) -> DataFrame:
    """The effective value of a property after some domains got new values: ``id``, ``value``. A domain whose flag
    says inherited takes its parent's effective value, level by level; others keep their own."""
    flag = f"{property}inherited"
    kind = domains.schema[property].dataType.simpleString()
    given = F.lit(None).cast(kind)
    for i, value in changed.items():
        given = F.when(F.col("id") == i, F.lit(value).cast(kind)).otherwise(given)
    own = domains.select(F.col("id").alias("ancestor"), F.coalesce(given, F.col(property)).alias("own"), (F.coalesce(F.col(flag), F.lit(False)) & ~F.col("id").isin(list(changed))).alias("takes"))
    up = ancestors(domains).join(own, "ancestor")
    # the nearest that keeps its own value, else the root
    nearest = F.min(F.when(~F.col("takes"), F.struct("distance", "own")))
    return up.groupBy("id").agg(nearest.alias("_n"), F.max(F.struct("distance", "own")).alias("_r")).select("id", F.when(F.col("_n").isNotNull(), F.col("_n.own")).otherwise(F.col("_r.own")).alias("value"))


def inherited_validity(pseudonyms: DataFrame, domains: DataFrame) -> DataFrame:
    """Pseudonyms whose start or end is inherited with that of their domain; others, and those of unknown domains, as
    they are."""
    d = domains.select(F.col("id").alias("domainid"), F.col("validfrom").alias("_from"), F.col("validto").alias("_to"), F.lit(True).alias("_found"))
    joined = pseudonyms.join(d, "domainid", "left")
    taken = lambda c: F.when(F.col("_found") & F.coalesce(F.col(f"{c}inherited"), F.lit(False)), F.col("_from" if c == "validfrom" else "_to")).otherwise(F.col(c)).alias(c)
    return joined.select(*[taken(c) if c in ("validfrom", "validto") else F.col(c) for c in pseudonyms.columns])


def without(domains: DataFrame, name: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """What remains after a domain and all below it are deleted: ``domains`` and the given tables, which name their
    domain in ``domainid`` or, as grants, in ``resource_id`` with type DOMAIN."""
    gone = subtree(domains, name).select(F.col("id").alias("_gone"))
    kept = {"domains": domains.join(gone, domains["id"] == gone["_gone"], "left_anti")}
    for label, rows in tables.items():
        if "domainid" in rows.columns:
            kept[label] = rows.join(gone, rows["domainid"] == gone["_gone"], "left_anti")
        else:
            kept[label] = rows.join(gone, (rows["resource_type"] == "DOMAIN") & (rows["resource_id"] == gone["_gone"]), "left_anti")
    return kept


def counts(domains: DataFrame, pseudonyms: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pseudonyms of the wanted domains (``domainid``); -1 for a domain that doesn't exist. Counted before the join."""
    held = pseudonyms.groupBy("domainid").agg(F.count(F.lit(1)).alias("n"))
    exists = domains.select(F.col("id").alias("domainid"), F.lit(True).alias("known"))
    return wanted.join(exists, "domainid", "left").join(held, "domainid", "left").select("domainid", F.when(F.col("known"), F.coalesce("n", F.lit(0))).otherwise(-1).alias("amount"))
