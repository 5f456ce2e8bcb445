"""Projections for output and predicates on requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.functions.normalize import blank

#: What anyone may see of a pseudonym and of a domain; everything else needs the complete view.
PSEUDONYM_VIEW = ["identifier", "idtype", "pseudonym"]
DOMAIN_VIEW = ["name", "prefix", "validfrom", "validto", "description", "superdomainid"]


def representation(columns: Sequence[str], labels: Sequence[str] | None = None) -> Column:
    """``label: value`` of all columns that aren't null, separated by commas."""
    return F.concat_ws(", ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))) for c, label in zip(columns, labels or columns)])


def reduced(rows: DataFrame, view: Sequence[str], permitted: Column | None = None, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Only the visible columns; with ``permitted``, per row, the others as well where it holds (else null)."""
    if permitted is None:
        return rows.select(*keep, *[c for c in view if c not in keep])
    return rows.select(*keep, *[F.col(c) if c in view else F.when(permitted, F.col(c)).alias(c) for c in rows.columns if c not in keep])


def attribute(rows: DataFrame, name: str, complete_view: bool = False, public: Sequence[str] = tuple(DOMAIN_VIEW)) -> DataFrame:
    """One attribute of each domain by name (letter case ignored): ``name``, ``value``; PermissionError for others than
    public ones without the complete view, KeyError for an unknown one."""
    known = {c.lower(): c for c in rows.columns}
    column = known[name.strip().lower()]
    if column not in public and not complete_view:
        raise PermissionError(f"{column} needs the complete view")
    return rows.select(F.col("name"), F.col(column).cast("string").alias("value"))


def unpivoted(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key``, ``attribute``, ``value`` of all given columns as text."""
    return rows.select(key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([key], list(columns), "attribute", "value")


def usable_request(identifier: Column, idtype: Column, domain: Column, psn: Column) -> Column:
    """Null for a request that can be looked up, else the reason why not."""
    has_id = ~blank(identifier) & ~blank(idtype)
    return F.when(blank(domain), "no domain").when(~has_id & blank(psn) & (blank(identifier) != blank(idtype)), "half an identifier").when(~has_id & blank(psn), "neither identifier nor pseudonym")


def standard_view(privileged: Sequence[Column]) -> Column:
    """Whether no privileged attribute is given."""
    test = F.lit(True)
    for c in privileged:
        test = test & c.isNull()
    return test


def permission_target(resource_type: Column, name: Column, abbreviation: Column) -> Column:
    """Whether exactly the label that the resource type needs is given: a name for domains, an abbreviation for
    projects, nothing for global rights."""
    kind = F.upper(resource_type)
    has_name, has_abbreviation = ~blank(name), ~blank(abbreviation)
    return F.when(kind == "DOMAIN", has_name & ~has_abbreviation).when(kind == "PROJECT", has_abbreviation & ~has_name).when(kind == "GLOBAL", ~has_name & ~has_abbreviation).otherwise(F.lit(False))
