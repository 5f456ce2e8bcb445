"""Exactly one copy of each message that was delivered at least once."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from veilframe.plans.durable import durable
from veilframe.plans.skew import HOT_ROWS, hot_groups, lookup

#: Sequence numbers of one producer are tracked in blocks of this many, which bounds what a task remembers.
BLOCK_NUMBERS = 1 << 16
#: Greatest number that ranges track; beyond it (where adding one might overflow) identifiers go by keyed lookup.
MOST_NUMBER = 1 << 62


class Ranges:
    """Disjoint half-open ranges of integers already seen."""

    def __init__(self) -> None:
        self.lows: list[int] = []
        self.highs: list[int] = []

    def accept(self, low: int, high: int | None = None) -> bool:
        """Adds [low, high) (one number if no ``high``); False if ``low`` was covered before."""
        high = low + 1 if high is None else high
        lows, highs = self.lows, self.highs
        if lows and lows[-1] <= low:  # the usual case: at the end
            k = len(lows) - 1
        else:
            k = bisect_right(lows, low) - 1
        if k >= 0 and low < highs[k]:
            if high <= highs[k]:
                return False
            fresh, first = False, k
        elif k >= 0 and highs[k] == low:
            fresh, first = True, k
        else:
            fresh, first = True, k + 1
            lows.insert(first, low)
            highs.insert(first, high)
        last = first
        while last + 1 < len(lows) and lows[last + 1] <= high:
            last += 1
        highs[first] = max(high, highs[last], highs[first])
        del lows[first + 1 : last + 1], highs[first + 1 : last + 1]
        return fresh


def _accept(batches: Iterator[pa.RecordBatch], group: Sequence[str], fields: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Goes through rows sorted by group and arrival and marks the first of each number; holds one group's ranges."""
    current, seen = None, Ranges()
    for batch in batches:
        columns = [batch.column(g).to_pylist() for g in group]
        numbers, upto = batch.column("number").to_pylist(), batch.column("upto").to_pylist()
        marks = []
        for *now, number, end in zip(*columns, numbers, upto):
            if now != current:
                current, seen = now, Ranges()
            marks.append(seen.accept(number, end))
        yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), pa.array(marks, pa.bool_())], names=[*fields, "fresh"])


def _sequence_number(c: Column) -> Column:
    """The number that a well-formed identifier stands for: 0 to ``MOST_NUMBER``, written in the usual form; else null."""
    value = c.try_cast("long")
    return F.when(value.between(0, MOST_NUMBER) & (value.cast("string") == c.cast("string")), value)


def deliveries(rows: DataFrame, producer: Sequence[str], number: str, time: str, row_id: str, seen: DataFrame | None = None, seen_odd: DataFrame | None = None, block_numbers: int = BLOCK_NUMBERS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Marks each row as the ``kept`` copy of its message or not: producer, ``number``, ``time``, ``id``, ``kept``.

    A message is a producer (columns compared as written) and its sequence number; of its copies the one of the
    earliest time, on ties the smallest id, is kept (a null time counts as latest). Rows that lack a part of the
    identifier belong to no message and are left out.

    Well-formed numbers (0 and up) go through seen ranges: rows of a producer and block of numbers, in order of
    arrival, are accepted if no range covers their number, and neighbouring ranges are merged. Rows stream through
    sorted partitions, so a task holds one block's ranges only. A block of more than ``hot_rows`` rows is first worked
    through in independent shares, and what they accepted meets once more per number, so neither a hot producer nor a
    message delivered very often is one task.

    Any other identifier is malformed: negative numbers and, where the column holds texts, whatever isn't a number in
    its usual form ("x7", "007"). These are resolved by exact keyed lookup of what is written. ``number`` keeps the
    column's own type. ``seen`` (producer, low, high) holds ranges accepted in earlier batches, see ``seen_ranges``;
    ``seen_odd`` (producer, number) the malformed identifiers accepted there, see ``seen_identifiers``.
    """
    producer = list(producer)
    written = rows.schema[number].dataType
    base = rows.select(*producer, F.col(number).alias("number"), F.col(time).alias("time"), F.col(row_id).alias("id"))
    for name in [*producer, "number"]:
        base = base.where(F.col(name).isNotNull())
    block = lambda c: (c - F.pmod(c, F.lit(block_numbers))).alias("block")
    whole = isinstance(written, T.IntegralType)
    regular = F.col("number").between(0, MOST_NUMBER)  # a plain range reaches the scan and its statistics
    good = base.where(regular).withColumn("number", F.col("number").cast("long")) if whole else base.withColumn("number", _sequence_number(F.col("number"))).where("number is not null")
    good = good.withColumn("upto", F.col("number") + 1).withColumn("earlier", F.lit(0)).withColumn("block", block(F.col("number")))
    hot = durable(hot_groups(good.groupBy(*producer, "block").agg(F.count(F.lit(1)).alias("n")), [*producer, "block"], rows=hot_rows))
    crowded = not hot.isEmpty()
    spread = (lambda some: some.join(F.broadcast(hot), [*producer, "block"], "left")) if crowded else (lambda some: some.withColumn("salts", F.lit(None).cast("int")))
    good = spread(good).withColumn("share", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int"))
    if seen is not None:
        low, high = F.col("low").cast("long"), F.col("high").cast("long")
        ranges = seen.select(*producer, low.alias("low"), high.alias("high")).withColumn("block", F.explode(F.sequence(block(low), block(high - 1), F.lit(block_numbers).cast("long"))))
        old = spread(ranges).select(*producer, F.greatest("low", "block").alias("number"), F.least(F.col("high"), F.col("block") + block_numbers).alias("upto"), "block", "salts", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("share"))
        old = old.withColumn("earlier", F.lit(-1)).withColumn("time", F.lit(None).cast(base.schema["time"].dataType)).withColumn("id", F.lit(None).cast(base.schema["id"].dataType))
        good = good.unionByName(old.select(*good.columns))
    fields = [*producer, "number", "upto", "earlier", "time", "id", "salts"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in good.select(*fields).schema) + ", fresh boolean"
    arrival = ["earlier", F.col("time").asc_nulls_last(), "id"]

    def round_of(df: DataFrame, group: list[str]) -> DataFrame:
        ordered = df.repartition(*group).sortWithinPartitions(*group, *arrival)
        return ordered.mapInArrow(lambda batches: _accept(batches, group, fields), schema)

    out = [*producer, F.col("number").cast(written).alias("number"), "time", "id"]
    first = round_of(good, [*producer, "block", "share"]).where("earlier = 0")
    if crowded:
        first = durable(first)  # two readers
        again = round_of(first.where("fresh and salts is not null").drop("fresh"), [*producer, "number"])
        ranged = first.where("not fresh or salts is null").select(*out, F.col("fresh").alias("kept")).unionByName(again.select(*out, F.col("fresh").alias("kept")))
    else:
        ranged = first.select(*out, F.col("fresh").alias("kept"))

    odd = base.where(~regular if whole else _sequence_number(F.col("number")).isNull())
    order = F.struct(F.col("time").isNull(), F.col("time"), F.col("id"))
    best = odd.groupBy(*producer, "number").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")).withColumn("best", F.col("best.id"))
    if seen_odd is not None:
        before = seen_odd.select(*producer, F.col("number").cast(written).alias("number")).distinct().withColumn("_before", F.lit(True))
        best = best.join(before, [*producer, "number"], "left").withColumn("best", F.when(F.col("_before").isNull(), F.col("best"))).drop("_before")
    exact = lookup(odd, best, [*producer, "number"], hot_rows=hot_rows).select(*producer, "number", "time", "id", F.coalesce(F.col("id") == F.col("best"), F.lit(False)).alias("kept"))
    return ranged.unionByName(exact)


def seen_ranges(kept: DataFrame, producer: Sequence[str], block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """The disjoint ranges (producer, low, high) that accepted rows cover, to be given to the next batch.

    Runs of successive numbers are found per producer and block (gaps-and-islands), so a range never spans two blocks
    and no producer is held by one task.
    """
    producer = list(producer)
    numbers = kept.where("kept").select(*producer, _sequence_number(F.col("number")).alias("number")).where("number is not null").distinct().withColumn("block", F.col("number") - F.pmod("number", F.lit(block_numbers)))
    run = F.col("number") - F.row_number().over(Window.partitionBy(*producer, "block").orderBy("number"))
    return numbers.withColumn("run", run).groupBy(*producer, "block", "run").agg(F.min("number").alias("low"), (F.max("number") + 1).alias("high")).drop("block", "run")


def seen_identifiers(kept: DataFrame, producer: Sequence[str]) -> DataFrame:
    """The malformed identifiers (producer, number as written) among accepted rows, to be given to the next batch."""
    return kept.where(F.col("kept") & _sequence_number(F.col("number")).isNull()).select(*list(producer), "number").distinct()
