"""The one-to-one assignment of greatest total weight, component by component."""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence
from heapq import heappop, heappush
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from veilframe.plans.durable import durable, release


def best(links: Sequence[tuple[Hashable, Hashable, int]]) -> set[int]:
    """Places in ``links`` (left, right, weight) of a one-to-one choice with the greatest total weight.

    Shortest augmenting paths with potentials, one per left record. Every left record may also stay alone, at weight 0,
    so the result is exact for any links; those of no weight are never chosen.
    """
    ways: dict[Hashable, list[tuple[Hashable, int, int]]] = {}
    for place, (x, y, weight) in enumerate(links):
        if weight > 0:
            ways.setdefault(x, []).append((y, weight, place))
    top = max((w for some in ways.values() for _, w, _ in some), default=0)
    owner: dict[Hashable, Hashable] = {}  # right -> left
    mate: dict[Hashable, tuple[Hashable, int]] = {}  # left -> right and the link's place
    u: dict[Hashable, int] = {}
    v: dict[Hashable, int] = {}  # potentials of left and right records; 0 for a free right one
    for start in ways:
        # A link costs top - weight and staying alone costs top; less the potentials no cost is negative.
        u[start] = min(top, *(top - w - v.get(y, 0) for y, w, _ in ways[start]))
        near: dict[Hashable, int] = {}
        came: dict[Hashable, tuple[Hashable, int]] = {}
        done: dict[Hashable, int] = {}
        queue: list[tuple[int, int, Hashable]] = []
        reached = {start: 0}
        x, far, pushed, free = start, 0, 0, None
        end, alone = top - u[start], start
        while True:
            for y, w, place in ways[x]:
                d = far + top - w - u[x] - v.get(y, 0)
                if y not in done and d < near.get(y, d + 1):
                    near[y], came[y], pushed = d, (x, place), pushed + 1
                    heappush(queue, (d, pushed, y))
            while queue and queue[0][2] in done:
                heappop(queue)
            if not queue or queue[0][0] >= end:
                break
            far, _, y = heappop(queue)
            done[y] = far
            if y not in owner:
                free, end = y, far
                break
            x = owner[y]
            reached[x] = far
            if far + top - u[x] < end:
                end, alone = far + top - u[x], x
        for x, d in reached.items():
            u[x] += end - d
        for y, d in done.items():
            v[y] = v.get(y, 0) - (end - d)
        if free is None and alone == start:
            continue
        y = mate.pop(alone)[0] if free is None else free
        while True:
            x, place = came[y]
            before = mate.get(x)
            mate[x], owner[y] = (y, place), x
            if x == start:
                break
            y = before[0]
    return {place for _, place in mate.values()}


def components(links: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """``links`` with ``component``, equal for links that are connected by shared left or right keys.

    Links take the smallest label of those they share a key with, then the label of the link so named, until nothing
    changes; each round is written out. Labels are hashes: equal ones only put two components together.
    """
    label = F.xxhash64(*left, *right)
    current = durable(links.withColumn("link", label).withColumn("component", label))
    while True:
        low = F.least(F.min("component").over(Window.partitionBy(*left)), F.min("component").over(Window.partitionBy(*right)))
        spread = durable(current.withColumn("low", low))
        if spread.where("low < component").isEmpty():
            release(spread)
            return current.drop("link")
        named = spread.groupBy(F.col("link").alias("low")).agg(F.min("low").alias("lower"))
        before, current = current, durable(spread.join(named, "low", "left").withColumn("component", F.least("low", "lower")).select(*current.columns))
        release(before, spread)


def choose(links: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """The links of the one-to-one assignment with the greatest total ``weight``, exact; ``left`` and ``right`` name the
    keys. A component is worked out by one task, in memory."""
    columns = links.columns
    sorted_links = components(links, left, right).select(*columns, "component").repartition("component").sortWithinPartitions("component", *left, *right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, label, names = [], None, None
        for batch in batches:
            names = batch.schema
            for row in batch.to_pylist():
                if held and row["component"] != label:
                    yield chosen(held, names)
                    held = []
                label = row["component"]
                held.append(row)
        if held:
            yield chosen(held, names)

    def chosen(rows: list[dict[str, Any]], schema: pa.Schema) -> pa.RecordBatch:
        places = best([(tuple(r[c] for c in left), tuple(r[c] for c in right), r["weight"]) for r in rows])
        return pa.RecordBatch.from_pylist([rows[k] for k in sorted(places)], schema=schema).select(columns)

    return sorted_links.mapInArrow(run, links.schema)
