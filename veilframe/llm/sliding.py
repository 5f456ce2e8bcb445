"""Sliding-window comparison of sorted records, vectorised over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa

#: What a sorted record brings: its order, what is compared at once (codes, 0 for unknown) and what is passed on.
RECORD = [("part", pa.int32()), ("place", pa.int64()), ("stretch", pa.int64()), ("own", pa.int64()), ("pass", pa.int32()), ("project_id", pa.int32()), ("birth", pa.int32()), ("phone", pa.int64()), ("email", pa.int64()), ("street", pa.int64()), ("zip", pa.int64()), ("sex", pa.int64()), ("record", pa.binary()), ("first", pa.string()), ("last", pa.string())]
PAIR = [("other", pa.binary()), ("other_project", pa.int32()), ("other_first", pa.string()), ("other_last", pa.string()), ("other_birth", pa.int32()), ("apart", pa.float64())]
OUT = pa.schema([("kind", pa.int32()), *RECORD, *PAIR])
#: Kinds of rows that come out: a pair, a record at the edge of its partition, a partition's number of records.
PAIRED, EDGE, SIZE = 0, 1, 2

_NAMES = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.string(): "string", pa.float64(): "double"}
OUT_DDL = ", ".join(f"`{f.name}` {_NAMES[f.type]}" for f in OUT)


def birth_weight(a: np.ndarray, b: np.ndarray, w: Mapping[str, float]) -> np.ndarray:
    """Evidence of two dates yyyymmdd: equal, one step or an exchange of day and month, one or two parts off."""
    parts = [(x // 10000, x // 100 % 100, x % 100) for x in (a, b)]
    (ya, ma, da), (yb, mb, db) = parts
    off = (ya != yb).astype(int) + (ma != mb) + (da != db)
    near = (abs(ya - yb) == 1).astype(int) + (abs(ma - mb) == 1) + (abs(da - db) == 1)
    close = abs(ya - yb) <= 10
    exchanged = (ya == yb) & (ma == db) & (mb == da)
    step = exchanged | ((off == 1) & (near + (abs(ya - yb) == 10) == 1))
    return np.select([a == b, step, (off == 1) & close, (off == 2) & (near >= 1) & close], [w["same"], w["step"], w["one"], w["two"]], w["other"])


def apart(left: dict[str, np.ndarray], right: dict[str, np.ndarray], weights: Mapping[str, Mapping[str, float]]) -> np.ndarray:
    """Weight of everything but the names; what isn't known on both sides counts nothing."""
    known = (left["birth"] != 0) & (right["birth"] != 0)
    total = np.where(known, birth_weight(left["birth"], right["birth"], weights["birth"]), 0.0)
    for name in ("phone", "email", "street", "zip", "sex"):
        known = (left[name] != 0) & (right[name] != 0)
        total += np.where(known, np.where(left[name] == right[name], weights[name]["same"], weights[name]["other"]), 0.0)
    return total


def _nulls(fields, n: int) -> list[pa.Array]:
    return [pa.nulls(n, t) for _, t in fields]


def slide(window: int, reach: float, weights: Mapping[str, Mapping[str, float]], across: bool):
    """An Arrow partition function over sorted records (columns ``RECORD``).

    Every record is compared with the ``window`` records before it in its stretch and order, of other projects; pairs
    whose weight without names is at least ``reach`` come out. Only the last records of a batch are kept for the next
    one. With ``across`` only pairs from different partitions count (those within one are known already); without it
    the first and last ``window`` records of the partition, and its size, come out as well.
    """
    numbers = [n for n, t in RECORD if t not in (pa.binary(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        head: pa.Table | None = None
        total, part = 0, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            fresh = pa.Table.from_batches([batch]).combine_chunks()
            rows = fresh if kept is None else pa.concat_tables([kept, fresh]).combine_chunks()
            old = rows.num_rows - fresh.num_rows
            total += fresh.num_rows
            part = fresh.column("part")[0].as_py()
            if not across and (head is None or head.num_rows < window):
                head = fresh.slice(0, window) if head is None else pa.concat_tables([head, fresh.slice(0, window - head.num_rows)])
            values = {n: rows.column(n).to_numpy() for n in numbers}
            found_a, found_b, found_w = [], [], []
            for d in range(1, min(window, rows.num_rows - 1) + 1):
                a = np.arange(max(0, old - d), rows.num_rows - d)
                b = a + d
                ok = (values["pass"][a] == values["pass"][b]) & (values["project_id"][a] != values["project_id"][b])
                if across:
                    ok &= (values["stretch"][a] == values["stretch"][b]) & (values["own"][b] == values["stretch"][b]) & (values["part"][a] != values["part"][b]) & (values["place"][b] - values["place"][a] <= window)
                a, b = a[ok], b[ok]
                weight = apart({n: v[a] for n, v in values.items()}, {n: v[b] for n, v in values.items()}, weights)
                near = weight >= reach
                found_a.append(a[near])
                found_b.append(b[near])
                found_w.append(weight[near])
            if found_a and sum(map(len, found_a)):
                a, b, w = map(np.concatenate, (found_a, found_b, found_w))
                left, right = rows.take(a), rows.take(b)
                yield from _out(PAIRED, left, [right.column("record"), right.column("project_id"), right.column("first"), right.column("last"), right.column("birth"), pa.chunked_array([w])])
            kept = rows.slice(max(0, rows.num_rows - window))
        if not across and total:
            tail = kept.slice(max(0, kept.num_rows - max(0, total - head.num_rows)))
            edges = pa.concat_tables([head, tail]) if total > head.num_rows else head
            yield from _out(EDGE, edges, None)
            size = pa.Table.from_arrays([pa.array([part], pa.int32()), pa.array([total], pa.int64()), *_nulls(RECORD[2:], 1)], names=[n for n, _ in RECORD])
            yield from _out(SIZE, size, None)

    return run


def _out(kind: int, left: pa.Table, pair: list | None) -> Iterator[pa.RecordBatch]:
    n = left.num_rows
    columns = [pa.array(np.full(n, kind, np.int32)), *(left.column(name) for name, _ in RECORD), *(pair or _nulls(PAIR, n))]
    yield from pa.Table.from_arrays(columns, names=OUT.names).cast(OUT).to_batches(max_chunksize=20_000)
