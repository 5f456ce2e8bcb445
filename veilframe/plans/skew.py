"""Joins of rows with one row per group, where a group may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: Groups with more rows than this may be split.
HOT_ROWS = 50_000
#: No more groups than this are ever called hot, so the broadcast list of hot keys is bounded. By the pigeonhole
#: principle every group left out holds at most 1/HOT_GROUPS of all rows.
HOT_GROUPS = 10_000


def hot_groups(groups: DataFrame, keys: Sequence[str], n: str = "n", rows: int = HOT_ROWS, most: int = HOT_GROUPS) -> DataFrame:
    """The at most ``most`` largest groups of more than ``rows`` rows, with the number of salts ``salts``."""
    salts = F.ceil(F.col(n) / F.lit(rows)).cast("int")
    return groups.where(F.col(n) > rows).orderBy(F.col(n).desc(), *keys).limit(most).select(*keys, salts.alias("salts"))


def lookup(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner", n: str = "n", spread: str = "id", hot_rows: int = HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``groups`` (one row per key, row count in ``n``) without one task per hot key.

    The keys of hot groups, bounded in number, are broadcast to the rows; rows of a hot group are spread over salts by
    their ``spread`` column and the group's single row is repeated once per salt. Other groups join as they are.
    ``how``: inner or left_semi. Keys must not be null on either side (null keys find nothing). ``groups`` may have several
    rows per key if ``counts`` (keys and ``n``, one row per key) tells the sizes; each then meets all rows of its key.
    """
    keys = list(keys)
    hot = hot_groups(groups if counts is None else counts, keys, n, hot_rows)
    salted_rows = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(spread), F.col("salts"))).otherwise(0).cast("int")).drop("salts")
    count = F.col(n)
    repeats = F.when(count > hot_rows, F.ceil(count / F.lit(hot_rows))).otherwise(1).cast("int")
    salted_groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), repeats - 1)))
    if how == "left_semi":
        salted_groups = salted_groups.select(*keys, "salt")
    return salted_rows.join(salted_groups, [*keys, "salt"], how).drop("salt")


def mark_first(rows: DataFrame, keys: Sequence[str], order: str, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with ``name``: whether the row is the first (by ``order``, unique) of those with its keys.

    The least order of each key is aggregated partially and looked up, instead of a window that would sort all rows of
    a hot key in one task. Nulls in the keys equal each other.
    """
    keyed = rows.withColumn("_key", F.struct(*keys))
    least = keyed.groupBy("_key").agg(F.min(order).alias("_least"), F.count(F.lit(1)).alias("_n"))
    found = lookup(keyed, least, ["_key"], n="_n", spread=order, hot_rows=hot_rows)
    return found.select(*rows.columns, (F.col(order) == F.col("_least")).alias(name))
