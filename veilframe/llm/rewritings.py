"""Duplicates hidden by formatting, found by progressive partition refinement."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from veilframe.functions.jsondoc import canonical, digest, parse
from veilframe.plans.durable import durable
from veilframe.plans.skew import HOT_ROWS, lookup

#: Letters whose number no case folding changes (others arise from folding signs such as the sharp s, the long s, the
#: Kelvin sign or ligatures), and the digits.
STEADY = "bcdegmopqruvxz0123456789"
#: Bits of the filter of classes with several members (8 MB, whatever the number of classes).
FILTER_BITS = 1 << 26
#: Bytes of text that are counted at once.
_SLICE = 1 << 22

_KIND = np.zeros(256, np.int64)
for _k, _sign in enumerate(STEADY, 1):
    _KIND[[ord(_sign), ord(_sign.upper())]] = _k
_FACTORS = np.random.default_rng(1).integers(1, 1 << 63, len(STEADY) + 1, dtype=np.uint64) | np.uint64(1)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|.)", re.S)


def _unescaped(text: str) -> str:
    """JSON text with escaped ASCII signs put back and other escapes left out; they stand for no steady letter."""
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] and int(m[1], 16) < 128 else "", text)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def invariants(texts: pa.Array, scopes: np.ndarray) -> np.ndarray:
    """A 64-bit class per JSON text of its scope, its number of steady letters and digits and how often each occurs: the
    same for all writings of a record. The raw bytes of many texts are counted at once; only texts with a backslash are
    looked at one by one."""
    plain = texts.cast(pa.large_string())
    escaped = np.flatnonzero(pa.compute.find_substring(plain, "\\").to_numpy(zero_copy_only=False) >= 0)
    if len(escaped):
        values = plain.to_pylist()
        for k in escaped:
            values[k] = _unescaped(values[k])
        plain = pa.array(values, pa.large_string())
    n = len(plain)
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + n + 1]
    data = np.frombuffer(plain.buffers()[2], np.uint8) if plain.buffers()[2] is not None else np.zeros(0, np.uint8)
    counts = np.zeros((n, len(STEADY) + 1), np.uint64)
    at = 0
    while at < n:  # as many texts as fit a slice, one at least
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SLICE, "right")) - 1)
        kinds = _KIND[data[offsets[at] : offsets[stop]]]
        row = np.repeat(np.arange(stop - at), np.diff(offsets[at : stop + 1]))
        width = len(STEADY) + 1
        counts[at:stop] = np.bincount(row * width + kinds, minlength=(stop - at) * width).reshape(-1, width)
        at = stop
    counts[:, 0] = counts[:, 1:].sum(axis=1)
    with np.errstate(over="ignore"):
        return _mixed(_mixed((counts * _FACTORS).sum(axis=1, dtype=np.uint64)) + scopes.view(np.uint64)).view(np.int64)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(invariants(batch.column("data"), batch.column("scope").to_numpy()), pa.int64())], names=["class"])


def _digests(held: Broadcast, scope: Sequence[str]):
    """Rows whose class may have several members, with the digest of their canonical form. ``held``: the filter's words,
    by broadcast; a class that passes it wrongly costs one parse and changes no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        for batch in batches:
            bits = _mixed(invariants(batch.column("data"), batch.column("scope").to_numpy()).view(np.uint64)) % np.uint64(len(words) * 64)
            hits = np.flatnonzero((words[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63))) & np.uint64(1))
            some = batch.take(pa.array(hits))
            ids, keys = some.column("id").to_pylist(), []
            for *where, text in zip(*(some.column(c).to_pylist() for c in [*scope, "data"])):
                document = parse(text, exact=True)
                keys.append(None if document is None else digest(*where, canonical(document)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["id", "key"])

    return run


def _filter(several: DataFrame, bits: int) -> np.ndarray:
    """The words of a bit filter over the classes, combined by Spark: at most ``bits`` / 64 rows reach the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _mixed(batch.column("class").to_numpy().view(np.uint64)) % np.uint64(bits)
            mask = (np.uint64(1) << (bit & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array(mask)], names=["word", "mask"])

    rows = several.select("class").mapInArrow(places, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return words


def rewritings(rows: DataFrame, scope: Sequence[str], row_id: str = "id", data: str = "data", hot_rows: int = HOT_ROWS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Each row that has copies in other writing: ``id``, ``key`` (of its record), ``first_id``, ``n`` copies.

    Copies have equal ``scope`` columns (null equals null) and JSON objects that differ only in the order of fields
    and in the white space, letter case and punctuation of texts. Rows whose data is null or not one JSON object take
    no part; an empty table gives no row.

    Refinement goes by cheap invariants first: the number of steady letters and the histogram of them, counted on raw
    bytes without parsing. Only rows of classes with several members are parsed, and grouped by a 128-bit digest of the
    canonical form. The classes with several members are kept as a bit filter of fixed size, so the second pass over
    the data picks its rows where they lie: no document ever moves between tasks, only classes and digests do. Both
    levels count with partial aggregation, and rows of a hot record are salted.
    """
    scope = list(scope)
    names = [f"s{k}" for k in range(len(scope))]
    base = rows.where(F.col(data).isNotNull()).select(F.col(row_id).cast("long").alias("id"), *[F.col(c).alias(n) for c, n in zip(scope, names)], F.xxhash64(*scope).alias("scope"), F.col(data).alias("data"))
    coarse = base.select("scope", "data").mapInArrow(_classes, "class bigint")
    several = coarse.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = rows.sparkSession.sparkContext.broadcast(_filter(several, filter_bits))
    keyed = durable(base.mapInArrow(_digests(held, names), "id bigint, key binary").where("key is not null"))
    held.unpersist()
    records = keyed.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return lookup(keyed, records, ["key"], hot_rows=hot_rows)
