"""Running sums and maxima over ordered rows of a key in two levels, so that a hot key spans many tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilframe.plans.durable import durable
from veilframe.plans.skew import HOT_ROWS, hot_groups

#: Block of keys that aren't split; below every real block.
WHOLE = -(2**62)


def with_blocks(rows: DataFrame, keys: Sequence[str], position: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with ``block``: ``WHOLE`` for ordinary keys; the rows of hot keys are range-partitioned by key and
    position, and the block is the partition, so blocks are cut by count, wherever the rows of a key crowd.

    Keys are counted with a partial aggregation; only the bounded list of hot ones is broadcast. Rows of hot keys are
    written out with their blocks, so that all readers see the same. ``rows`` is read up to three times and should be
    durable; (keys, position) is unique in it, and keys aren't null.
    """
    keys = list(keys)
    hot = durable(hot_groups(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, rows=hot_rows).select(*keys))
    if hot.isEmpty():
        return rows.withColumn("block", F.lit(WHOLE).cast("long"))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = rows.join(F.broadcast(hot), keys, "left_semi").repartitionByRange(spread, *keys, position)
    cut = durable(many.withColumn("block", F.spark_partition_id().cast("long")))
    return rows.join(F.broadcast(hot), keys, "left_anti").withColumn("block", F.lit(WHOLE).cast("long")).unionByName(cut)


def neighbours(blocked: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """For each block of a hot key the last position before it and the first after it, among the key's other blocks:
    keys, ``block``, ``before``, ``after``. One row per block."""
    keys = list(keys)
    spans = blocked.where(F.col("block") != WHOLE).groupBy(*keys, "block").agg(F.min(position).alias("_low"), F.max(position).alias("_high"))
    order = Window.partitionBy(*keys).orderBy("block")
    return spans.select(*keys, "block", F.lag("_high").over(order).alias("before"), F.lead("_low").over(order).alias("after"))


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds, for each entry, its sum or maximum over all rows of the key up to and with this one.

    Needs ``block`` (see ``with_blocks``), monotone in ``order``; ``order`` must be unique within a key. Level one is a
    window per (key, block). Level two carries block totals onwards; only keys that have blocks take part, and of
    these one row per block, so no task sees all rows of a hot key.
    """
    keys, order, sums, maxima = list(keys), list(order), dict(sums or {}), dict(maxima or {})
    by_block = [*keys, "block"]
    inner = Window.partitionBy(*by_block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows
    for name, c in sums.items():
        scanned = scanned.withColumn(name, F.sum(c).over(inner))
    for name, c in maxima.items():
        scanned = scanned.withColumn(name, F.max(c).over(inner))
    totals = rows.where(F.col("block") != WHOLE).groupBy(*by_block).agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()], *[F.max(c).alias(f"_{k}") for k, c in maxima.items()])
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by_block, *[F.sum(f"_{k}").over(before).alias(f"_{k}") for k in sums], *[F.max(f"_{k}").over(before).alias(f"_{k}") for k in maxima])
    joined = scanned.join(carried, by_block, "left")
    for name in sums:
        joined = joined.withColumn(name, F.col(name) + F.coalesce(F.col(f"_{name}"), F.lit(0))).drop(f"_{name}")
    for name in maxima:
        joined = joined.withColumn(name, F.greatest(F.col(name), F.col(f"_{name}"))).drop(f"_{name}")
    return joined
