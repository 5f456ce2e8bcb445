"""Pseudonyms linked through the tree: a child's identifier is its parent's pseudonym."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.operators.tree import subtree

HELD = ["id", "identifier", "idtype", "pseudonym", "domainid"]


def hop(chain: DataFrame, pseudonyms: DataFrame) -> DataFrame:
    """One step along the chain: rows whose identifier is the present pseudonym, or whose pseudonym is the present
    identifier. An OR of two equalities has no hash join, so it is two equi-joins; the second leaves out what the
    first found, so every pair comes once."""
    onward = pseudonyms.select(*[F.col(c).alias(f"_{c}") for c in HELD])
    down = chain.join(onward, F.col("pseudonym") == F.col("_identifier"))
    up = chain.join(onward, F.col("identifier") == F.col("_pseudonym")).where(~F.col("pseudonym").eqNullSafe(F.col("_identifier")))
    both = down.unionByName(up)
    return both.select(*[c for c in chain.columns if c not in HELD], *[F.col(f"_{c}").alias(c) for c in HELD])


def linked(pseudonyms: DataFrame, start: Column, steps: int, target: int, domains: list[int] | None = None) -> DataFrame:
    """Pairs of a source row (``source_id``) and every row of domain ``target`` (``target_id``) that ``steps`` hops
    reach. ``start`` filters the source rows and is applied first. Domains on the way are free, unless ``domains``
    (source to target) restricts each step; one step of path length 1 links a row with itself."""
    chain = pseudonyms.where(start).select(F.col("id").alias("source_id"), *HELD)
    for step in range(steps):
        nearby = pseudonyms if domains is None else pseudonyms.where(F.col("domainid") == domains[step + 1])
        chain = hop(chain, nearby)
    return chain.where(F.col("domainid") == target).select("source_id", F.col("id").alias("target_id"))


def of_instances(instances: DataFrame, pseudonyms: DataFrame, domains: DataFrame, domain_name: str, idtype: str, most: int | None = None) -> DataFrame:
    """All pseudonyms of instances: those that the named domain holds for their uid, and those linked to these in each
    domain below, by depth: ``instance_uid``, ``pseudonym``, ``domainid``."""
    tree = subtree(domains, domain_name)
    root = tree.where("depth = 0").select(F.col("id").alias("domainid"))
    # a null domain of the first join never matches
    first = instances.select(F.col("instance_uid").alias("identifier")).withColumn("idtype", F.lit(idtype)).join(pseudonyms.select(*HELD), ["identifier", "idtype"]).join(F.broadcast(root), "domainid", "left_semi")
    chain = first.select(F.col("identifier").alias("instance_uid"), *HELD)
    found = [chain]
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    for depth in range(1, deepest + 1):
        level = tree.where(F.col("depth") == depth).select(F.col("id").alias("domainid"))
        chain = hop(chain, pseudonyms.join(F.broadcast(level), "domainid", "left_semi"))
        found.append(chain)
    result = reduce(DataFrame.unionByName, found).select("instance_uid", "pseudonym", "domainid").distinct()
    return result.orderBy("instance_uid", "domainid", "pseudonym").limit(most) if most else result
