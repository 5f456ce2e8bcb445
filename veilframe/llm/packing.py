"""Filling containers of fixed capacity with whole documents under a target mixture of sources."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from veilframe.plans.durable import durable

#: Room (in tokens, an empty document counting 1) that one task packs.
PART_TOKENS = 4_000_000
#: Containers' worth of tokens drawn from the source queues per window.
WINDOW_CONTAINERS = 4


class Containers:
    """Containers of one capacity, filled best fit; containers with room left stay open for later windows."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.count, self.open = capacity, 0, []

    def put(self, size: int) -> int:
        """The number of the container with the least room that still takes ``size`` (a new one if none does)."""
        k = bisect_left(self.open, (size, -1))
        if size < self.capacity and k < len(self.open):
            room, container = self.open.pop(k)
        else:
            room, container = self.capacity, self.count
            self.count += 1
        if room > size or size == 0:
            insort(self.open, (room - size, container))
        return container


def windows(queues: dict[str, deque], target: Mapping[str, float], deficit: dict[str, float], window: int) -> Iterator[list[tuple]]:
    """Draws windows of about ``window`` tokens by deficit round-robin: each round adds a source's share of what is left
    of the window to its deficit and takes documents from its queue while the deficit covers them. What isn't used is
    carried to the next window; an overdraft (a document larger than the share left) is paid back there. A source
    without documents passes its share on to the others, in proportion, and keeps the deficit it has."""
    waiting = sorted(s for s in queues if queues[s])
    share: list[tuple[str, float, deque]] = []
    while waiting:
        drawn: list[tuple] = []
        room = window
        while room > 0 and waiting:
            if len(share) != len(waiting):  # some source ran out
                total = sum(target[s] for s in waiting)
                share = [(s, target[s] / total if total > 0 else 1 / len(waiting), queues[s]) for s in waiting]
            quantum, emptied = room, False
            for s, part, queue in share:
                credit = deficit[s] + quantum * part
                size = queue[0][1] or 1
                # half of a document is enough: over- and underdrafts of a source stay below half of one
                while size <= 2 * credit:
                    item = queue.popleft()
                    credit -= size
                    room -= size
                    drawn.append((*item, s))
                    if not queue:
                        emptied = True
                        break
                    size = queue[0][1] or 1
                deficit[s] = credit
            if emptied:
                waiting = [s for s in waiting if queues[s]]
        yield drawn


def pack_part(items: Iterable[tuple], target: Mapping[str, float], deficit: Mapping[str, float], capacity: int, window_containers: int = WINDOW_CONTAINERS) -> Iterator[tuple]:
    """(doc_id, source, piece, tokens, container, window) of one part's items (doc_id, tokens, source); from 0."""
    queues: dict[str, deque] = {}
    for doc, size, source in sorted(items, key=lambda x: (x[2], x[0])):
        queues.setdefault(source, deque()).append((doc, size))
    containers = Containers(capacity)
    shares = {s: target.get(s, 0.0) for s in queues}
    carried = {s: deficit.get(s, 0.0) for s in queues}
    for number, drawn in enumerate(windows(queues, shares, carried, window_containers * capacity)):
        pieces = []
        for doc, size, source in drawn:
            full, rest = divmod(size, capacity) if size > capacity else (0, size)
            for k in range(full):
                yield doc, source, k, capacity, containers.put(capacity), number
            if rest or not full:
                pieces.append((rest, doc, full, source))
        for size, doc, piece, source in sorted(pieces, key=lambda x: (-x[0], x[1])):
            yield doc, source, piece, size, containers.put(size), number


def _named(source: Column) -> Column:
    """A source as a key: a null one is told apart from an empty one."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def proportions(docs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``key`` and ``target`` of each source of ``docs`` (``key``, ``weight``): its share of ``targets`` (``source``,
    ``share``; any positive numbers, 0 for a source not named), else of the corpus's tokens. One row per source."""
    held = docs.groupBy("key").agg(F.sum("weight").alias("target"))
    if targets is None:
        return held.select("key", F.col("target").cast("double").alias("target"))
    asked = targets.select(_named(F.col("source")).alias("key"), F.greatest(F.coalesce(F.col("share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("share")).groupBy("key").agg(F.sum("share").alias("share"))
    return held.select("key").join(asked, "key", "left").select("key", F.coalesce("share", F.lit(0.0)).alias("target"))


def pack(sizes: DataFrame, capacities: DataFrame, targets: DataFrame | None = None, part_tokens: int = PART_TOKENS, window_containers: int = WINDOW_CONTAINERS) -> DataFrame:
    """Packs documents (``doc_id``, ``source``, ``tokens``) into containers of each of ``capacities``
    (``container_id``, ``capacity_tokens``): one row per document, or per piece of a document longer than a container,
    with ``source``, ``container`` and ``window`` (numbers unique within their kind), ``piece`` and ``tokens``.

    Only documents longer than the capacity are split: into full containers and a rest that is packed as a whole.
    Empty documents take no room but get a container; a null size counts as 0, a null source is a source of its own.
    An empty input gives no rows. ``capacities`` is configuration, a few rows; a null or non-positive one is left out.

    The mixture: ``targets`` (``source``, ``share``) or, without them, the corpus's proportions of tokens. Documents
    are drawn in windows of ``window_containers`` containers' worth, each filled to the target proportions by deficit
    round-robin over the source queues, deficits carried on; within a window the largest go first, each into the open
    container it fills best. Every document is packed, so once a source has none left the others share its part.

    Documents are spread by hash over parts of about ``part_tokens``, so no task holds more than that of any source.
    The deficits of a part begin where those of all parts before it end: the corpus's share of their tokens, less what
    they hold of the source.
    """
    kinds = [(int(r[0]), int(r[1])) for r in capacities.select("container_id", "capacity_tokens").where("capacity_tokens > 0").collect()]
    tokens = F.coalesce("tokens", F.lit(0)).cast("long")
    docs = durable(sizes.select(F.col("doc_id").cast("long").alias("doc_id"), _named(F.col("source")).alias("key"), tokens.alias("tokens"), F.greatest(tokens, F.lit(1)).alias("weight")))
    total = docs.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_tokens))
    placed = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("long"))

    held = placed.groupBy("part", "key").agg(F.sum("weight").alias("held"))
    of_source = held.groupBy("key").agg((F.sum("held") / F.lit(max(total, 1))).alias("share"))
    of_part = held.groupBy("part").agg(F.sum("held").alias("of_part"))
    # one row per part and source, so that a part without documents of a source carries its deficit on
    grid = of_source.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(of_part, "part").join(held, ["part", "key"], "left")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.select("part", "key", F.coalesce(F.sum(F.col("share") * F.col("of_part") - F.coalesce("held", F.lit(0))).over(before), F.lit(0.0)).alias("deficit"))

    nothing = lambda kind: F.lit(None).cast(kind)
    mark = carried.join(proportions(docs, targets), "key").select("part", "key", nothing("long").alias("doc_id"), nothing("long").alias("tokens"), "target", "deficit")
    rows = placed.select("part", "key", "doc_id", "tokens", nothing("double").alias("target"), nothing("double").alias("deficit")).unionByName(mark)

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        marks, items = part[part["doc_id"].isna()], part[part["doc_id"].notna()]
        target, deficit = dict(zip(marks["key"], marks["target"])), dict(zip(marks["key"], marks["deficit"]))
        documents = list(zip(items["doc_id"].astype("int64"), items["tokens"].astype("int64"), items["key"]))
        number = int(part["part"].iloc[0])
        out = []
        for kind, capacity in kinds:
            out += [(kind, number, c, w, int(doc), source, piece, int(size)) for doc, source, piece, size, c, w in pack_part(documents, target, deficit, capacity, window_containers)]
        return pd.DataFrame(out, columns=["container_id", "part", "within", "draw", "doc_id", "key", "piece", "tokens"])

    packed = rows.groupBy("part").applyInPandas(fill, "container_id int, part bigint, within bigint, draw bigint, doc_id bigint, key string, piece bigint, tokens bigint")
    number = lambda c: F.col("part") * F.lit(1 << 32) + F.col(c)
    source = F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1))
    return packed.select("container_id", number("within").alias("container"), number("draw").alias("window"), "doc_id", source.alias("source"), "piece", "tokens")


def mixture_report(packed: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """How each window keeps to the target: ``container_id``, ``window``, ``source``, ``tokens`` drawn (an empty
    document counts 1), ``share`` of the window's tokens, ``target`` and ``deviation``, the difference; one row for each
    source in a window. ``packed`` should be durable."""
    weights = packed.select("container_id", "window", _named(F.col("source")).alias("key"), F.greatest("tokens", F.lit(1)).alias("weight"))
    one = weights.where(F.col("container_id") == packed.agg(F.min("container_id")).first()[0])
    wanted = proportions(one, targets)
    total = wanted.agg(F.sum("target")).first()[0] or 1.0
    drawn = weights.groupBy("container_id", "window", "key").agg(F.sum("weight").alias("tokens"))
    of_window = drawn.groupBy("container_id", "window").agg(F.sum("tokens").alias("whole"))
    joined = drawn.join(of_window, ["container_id", "window"]).join(wanted.select("key", (F.col("target") / F.lit(float(total))).alias("target")), "key")
    share = F.col("tokens") / F.col("whole")
    return joined.select("container_id", "window", F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1)).alias("source"), "tokens", share.alias("share"), "target", (share - F.col("target")).alias("deviation"))


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per kind of container: how many there are, the tokens in them and the share of their room that is used."""
    used = packed.groupBy("container_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    kinds = capacities.select("container_id", "capacity_tokens")
    return used.join(kinds, "container_id").select("container_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))
