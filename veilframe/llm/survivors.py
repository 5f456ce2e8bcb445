"""The best representative of each group of duplicate records by token-level consensus."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilframe.functions.jsondoc import clean, definitions, digest, known, parse, plain, scalars, text_of
from veilframe.llm.consensus import Profile, distance
from veilframe.plans.durable import durable, release
from veilframe.plans.skew import HOT_ROWS, lookup

CELL = ["first_id", "field"]
#: Different values of one cell that are aligned one after the other, and profiles that are merged at once.
LEAF_VALUES = 256


def _read(groups: dict, keys: dict[int, str]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            ids, projects, types, texts, deleted, updated = (c.to_pylist() for c in batch.columns)
            for i, project, kind, text, gone, when in zip(ids, projects, types, texts, deleted, updated):
                if kind not in keys or (document := parse(text)) is None:
                    continue
                number = document.get(keys[kind])
                if number is None or isinstance(number, (dict, list)) or not (number := plain(text_of(number))):
                    continue
                cells = [] if gone else [(f, v) for f, v in scalars(document, groups.get(kind, {})) if f != keys[kind] and known(v)]
                for column, value in zip(out, (i, digest(project, kind, number), when, [clean(f) for f, _ in cells], [clean(text_of(v)) for _, v in cells])):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())))], names=["id", "key", "updated", "fields", "values"])

    return read


def cells(instances: DataFrame, types: DataFrame, numbers: Mapping[int, str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every known scalar of the groups: ``first_id``, ``field``, ``value``, ``updated`` (µs, null: earliest), ``id``.

    A group is two or more rows of one project and type whose record number, found under the name ``numbers`` gives
    for the type, has the same plain form; ``first_id`` is its smallest id. Deleted rows belong to the group but give
    no value. Rows whose data is null or not one JSON object, or that have no record number, belong to none.
    """
    groups = definitions([(r[0], r[1]) for r in types.select("id", "type_definition").collect()])
    base = instances.select(F.col("id").cast("long").alias("id"), F.col("project_id"), F.col("entity_type_id").cast("int").alias("entity_type_id"), "data", F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"), F.unix_micros("updated_at").alias("updated"))
    rows = durable(base.where("data is not null").mapInArrow(_read(groups, dict(numbers)), "id bigint, key binary, updated bigint, fields array<string>, values array<string>"))
    several = rows.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = lookup(rows.where(F.size("fields") > 0), several, ["key"], hot_rows=hot_rows)
    return found.select("first_id", "updated", "id", F.explode(F.arrays_zip("fields", "values")).alias("c")).select("first_id", F.col("c.fields").alias("field"), F.col("c.values").alias("value"), "updated", "id")


_KEYS = ["first_id", "field", "leaf"]
_PROFILE = "first_id bigint, field string, leaf bigint, profile binary"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one group after the other, from batches sorted by ``_KEYS``."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in _KEYS):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _aligned(variants: list[dict]) -> Profile:
    """The profile of a group's values, most frequent first, then the latest."""
    profile = Profile()
    for v in sorted(variants, key=lambda v: (-v["rows"], -v["updated"], -v["id"])):
        profile.merge(Profile.of(v["value"].split(), (v["rows"], (v["updated"], v["id"]))))
    return profile


def _nearest(variants: list[dict], text: list[str]) -> dict:
    return max(variants, key=lambda v: (-distance(v["value"].split(), text), v["updated"], v["id"]))


def _chosen(recency: bool):
    """Groups of variants to the one that survives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for variants in _grouped(batches):
            best = _nearest(variants, _aligned(variants).consensus(recency))
            out.append((best["first_id"], best["field"], best["value"], best["id"]))
            if len(out) >= 5_000:
                yield _survived(out)
                out = []
        yield _survived(out)

    return run


def _survived(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["first_id", "field", "value", "value_id"])


def _profiles(leaves: bool):
    """Groups of variants (``leaves``) or of profiles to the profile of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _grouped(batches):
            if leaves:
                profile = _aligned(some)
            else:
                profile = Profile()
                for row in sorted(some, key=lambda r: r["child"]):
                    profile.merge(pickle.loads(row["profile"]))
            yield pa.RecordBatch.from_arrays([pa.array([some[0]["first_id"]], pa.int64()), pa.array([some[0]["field"]], pa.string()), pa.array([some[0]["leaf"]], pa.int64()), pa.array([pickle.dumps(profile)], pa.binary())], names=[*_KEYS, "profile"])

    return run


def _voted(recency: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [" ".join(pickle.loads(p).consensus(recency)) for p in batch.column("profile").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("first_id"), batch.column("field"), pa.array(texts, pa.string())], names=[*CELL, "text"])

    return run


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, texts = batch.column("value").to_pylist(), batch.column("text").to_pylist()
        far = [distance(v.split(), (t or "").split()) for v, t in zip(values, texts)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*CELL, "value", "updated", "id")), pa.array(far, pa.int64())], names=[*CELL, "value", "updated", "id", "far"])


def _of_large_cells(variants: DataFrame, leaf_values: int, recency: bool, hot_rows: int) -> DataFrame:
    """Survivors of cells with more values than a task aligns one after the other: leaves of about ``leaf_values`` values
    are aligned apart, their profiles are aligned with each other level by level, and the values are compared with the
    consensus wherever they are. The tree follows from the values, not from the cluster."""
    leaves = F.ceil(F.col("n") / F.lit(leaf_values)).cast("long")
    placed = durable(variants.withColumn("leaf", F.pmod(F.xxhash64("value"), leaves)))
    ordered = lambda df: df.repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    profiles = durable(ordered(placed.select("first_id", "field", "leaf", "value", "rows", "updated", "id")).mapInArrow(_profiles(True), _PROFILE))
    while not profiles.where("leaf > 0").isEmpty():
        above = profiles.select("first_id", "field", F.col("leaf").alias("child"), F.floor(F.col("leaf") / leaf_values).cast("long").alias("leaf"), "profile")
        before, profiles = profiles, durable(ordered(above.select(*_KEYS, "child", "profile")).mapInArrow(_profiles(False), _PROFILE))
        release(before)
    texts = profiles.mapInArrow(_voted(recency), "first_id bigint, field string, text string")
    counted = placed.groupBy(*CELL).agg(F.first("n").alias("n")).join(texts, CELL)
    met = lookup(placed.drop("n", "leaf"), counted, CELL, hot_rows=hot_rows).select(*CELL, "value", "text", "updated", "id")
    measured = met.mapInArrow(_measured, "first_id bigint, field string, value string, updated bigint, id bigint, far bigint")
    best = measured.groupBy(*CELL).agg(F.max(F.struct((-F.col("far")).alias("d"), "updated", "id", "value")).alias("b"))
    return best.select(*CELL, F.col("b.value").alias("value"), F.col("b.id").alias("value_id"))


def survivors(found: DataFrame, weighting: str = "recency", hot_rows: int = HOT_ROWS, leaf_values: int = LEAF_VALUES) -> DataFrame:
    """For each cell the value that survives: ``first_id``, ``field``, ``value``, ``value_id``.

    The different values of a cell (counted before the shuffle) are split at white space and aligned progressively:
    value after value, the most frequent first, joins a growing profile at the least sum of differing pairs, however
    long it is. In each column the tokens, or the gap, are voted on, and the existing value with the fewest tokens to
    change from the winning ones survives. ``value_id`` is the latest row that has it; ties go to the later row
    (updated, null first, then id). Cells with one value skip the vote.

    ``weighting``: ``majority`` counts each row once. ``recency`` gives each row more weight than all rows before it
    together; sums of such weights compare as their latest row does, so that row is what a vote carries.

    A cell of at most ``leaf_values`` different values is worked out in one pass by one task; a larger one along a
    tree of such groups (see ``_of_large_cells``), so no task holds more.
    """
    recency = {"recency": True, "majority": False}[weighting]
    rank = F.struct(F.coalesce("updated", F.lit(-(2**63))).alias("updated"), F.col("id").alias("id"))
    variants = durable(found.groupBy(*CELL, "value").agg(F.max(rank).alias("rank"), F.count(F.lit(1)).alias("rows")))
    summary = variants.groupBy(*CELL).agg(F.max(F.struct(F.col("rank"), F.col("value"))).alias("best"), F.count(F.lit(1)).alias("n"))
    summary = durable(summary)
    agreed = summary.where("n = 1").select(*CELL, F.col("best.value").alias("value"), F.col("best.rank.id").alias("value_id"))
    spread = variants.select(*CELL, "value", "rows", "rank.updated", "rank.id")
    contested = lookup(spread, summary.where("n > 1").select(*CELL, "n"), CELL, hot_rows=hot_rows)
    few = contested.where(F.col("n") <= leaf_values).select("first_id", "field", F.lit(0).cast("long").alias("leaf"), "value", "rows", "updated", "id")
    chosen = few.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(_chosen(recency), "first_id bigint, field string, value string, value_id bigint")
    result = agreed.unionByName(chosen)
    if summary.where(F.col("n") > leaf_values).isEmpty():
        return result
    return result.unionByName(_of_large_cells(contested.where(F.col("n") > leaf_values), leaf_values, recency, hot_rows))


def records(chosen: DataFrame) -> DataFrame:
    """One surviving record per group: ``first_id``, ``record`` and ``sources`` (field -> value, field -> row id)."""
    pairs = F.sort_array(F.collect_list(F.struct("field", "value", "value_id")))
    return chosen.groupBy("first_id").agg(pairs.alias("p")).select("first_id", F.map_from_arrays("p.field", "p.value").alias("record"), F.map_from_arrays("p.field", "p.value_id").alias("sources"))
