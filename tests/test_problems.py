"""The general problems against brute force, on hard small cases."""

import json
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from veilframe.functions.jsondoc import definitions, fields_of, parse
from veilframe.operators.delivery import Ranges, deliveries, seen_identifiers, seen_ranges
from veilframe.operators.intervals import sweep
from veilframe.operators.sessions import numbered, session_values, sessions
from veilframe.operators.shred import columns_of, elements, flat_table, nodes, shredded
from veilframe.plans.durable import durable
from veilframe.plans.prefix import with_blocks
from veilframe.plans.skew import lookup
from veilframe.queries import problems


def brute_intervals(rows):
    by = defaultdict(list)
    for k, a, b in rows:
        if k is not None and a is not None and b is not None and b > a:
            by[k].append((a, b))
    out = []
    for k, some in by.items():
        periods = []
        for a, b in sorted(some):
            if periods and a <= periods[-1][1]:
                periods[-1][1], periods[-1][2] = max(b, periods[-1][1]), periods[-1][2] + 1
            else:
                periods.append([a, b, 1])
        out += [(k, "period", a, b, n) for a, b, n in periods]
        out += [(k, "gap", p[1], q[0], None) for p, q in zip(periods, periods[1:])]
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1, 5, 10_000])
def test_sweep(spark, hot):
    r = random.Random(hot)
    rows = [("a" if r.random() < 0.6 else r.choice("bcd"), r.randrange(-60, 200), r.randrange(-60, 200)) for _ in range(120)]
    rows = [(k, a, a + abs(b) % 9) for k, a, b in rows] + rows[:3] + [(None, 1, 2), ("a", None, 3), ("b", 4, None), ("c", 5, 5), ("d", 9, 3)]
    df = spark.createDataFrame(rows, "k string, a long, b long").withColumn("block", F.lit(1)).withColumn("t", F.lit(2))
    got = sorted((tuple(x) for x in sweep(df, ["k"], "a", "b", hot_rows=hot).collect()), key=str)
    assert got == brute_intervals(rows)


def test_sweep_of_nothing(spark):
    assert sweep(spark.createDataFrame([], "k string, a long, b long"), ["k"], "a", "b").count() == 0


def brute_sessions(rows, gap):
    by = defaultdict(list)
    for k, t, i, _ in rows:
        if k is not None and t is not None:
            by[k].append((t, i))
    out = []
    for k, some in by.items():
        session = []
        for t, i in sorted(some):
            if session and t - session[-1][0] > gap:
                out.append((k, session))
                session = []
            session.append((t, i))
        out.append((k, session))
    return out


@pytest.mark.parametrize("hot", [1, 20, 10_000])
def test_sessions(spark, hot):
    r = random.Random(hot)
    rows = [(r.choice("aaab") if r.random() < 0.97 else None, r.randrange(0, 3000) if r.random() < 0.97 else None, i, r.choice("xyz")) for i in range(300)]
    rows += [("a", rows[0][1], 1000, "x"), ("a", -50, 1001, None)]
    df = spark.createDataFrame(rows, "k string, t long, id long, u string").withColumn("key", F.lit("clash"))
    want = brute_sessions(rows, 10)
    got = sessions(df, "k", "t", "id", gap_us=10, hot_rows=hot).collect()
    assert sorted((x.key, x.first_id, x.last_id, x.start_us, x.end_us, x.n) for x in got) == sorted((k, s[0][1], s[-1][1], s[0][0], s[-1][0], len(s)) for k, s in want)
    urls = {(x.key, x.session): x.distinct_values for x in session_values(df, "k", "t", "u", 10, hot).collect()}
    value = {i: u for _, _, i, u in rows}
    by_start = {(x.key, x.first_id): urls.get((x.key, x.session), 0) for x in got}
    assert by_start == {(k, s[0][1]): len({value[i] for _, i in s} - {None}) for k, s in want}


def test_sessions_of_nothing(spark):
    none = spark.createDataFrame([], "k string, t long, id long")
    assert sessions(none, "k", "t", "id").count() == 0 and numbered(none, "k", "t").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 6))))
def test_ranges(adds):
    ranges, covered = Ranges(), set()
    for low, size in adds:
        assert ranges.accept(low, low + size) == (low not in covered)
        covered |= set(range(low, low + size))
        assert ranges.lows == sorted(ranges.lows) and all(h < l for h, l in zip(ranges.highs, ranges.lows[1:]))
        assert {x for l, h in zip(ranges.lows, ranges.highs) for x in range(l, h)} == covered


def brute_deliveries(rows):
    by = defaultdict(list)
    for a, p, o, t, i in rows:
        if None not in (a, p, o):
            by[a, p, o].append((t is None, t or 0, i))
    return {x[2]: x == min(some) for some in by.values() for x in some}


@pytest.mark.parametrize("hot", [2, 40, 10_000])
@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_deliveries(spark, hot, kind):
    r = random.Random(5)
    odd = [None, -1, -2, 7, 7, 7, 2**31 - 1] if kind == "int" else [None, -1, 2**63 - 1, 2**62, 7, 7, 7]
    odd += [] if kind != "string" else ["", "x7", "007", "7 ", "+7", "1.0", "9" * 40]
    rows = [(r.choice(["p", "P", None]), r.choice([0, 1, None]), r.choice([*odd, *range(60)]), r.choice([None, 1, 2, 3]), i) for i in range(900)]
    if kind == "string":
        rows = [(a, p, None if o is None else str(o), t, i) for a, p, o, t, i in rows]
    df = spark.createDataFrame(rows, f"topic string, partition int, o {kind}, t int, id long").withColumn("block", F.lit("x")).withColumn("share", F.lit("y")).withColumn("salts", F.lit(3))
    out = deliveries(df, ["topic", "partition"], "o", "t", "id", block_numbers=8, hot_rows=hot)
    got = out.collect()
    assert {x.id: x.kept for x in got} == brute_deliveries(rows) and {x.id: x.number for x in got} == {x[4]: x[2] for x in rows if x[4] in {y.id for y in got}}


@pytest.mark.parametrize("hot", [1, 10_000])
def test_deliveries_over_batches(spark, hot):
    schema = "topic string, partition int, o string, t long, id long"
    first = spark.createDataFrame([("p", 0, str(n), k, k) for k, n in enumerate([1, 2, 3, 9, 10, "a", "a", "01"])], schema)
    kept = deliveries(first, ["topic", "partition"], "o", "t", "id", block_numbers=8, hot_rows=hot)
    ranges, odd = seen_ranges(kept, ["topic", "partition"], block_numbers=8), seen_identifiers(kept, ["topic", "partition"])
    assert sorted((x.low, x.high) for x in ranges.collect()) == [(1, 4), (9, 11)] and sorted(x.number for x in odd.collect()) == ["01", "a"]
    again = spark.createDataFrame([("p", 0, str(n), 0, 100 + k) for k, n in enumerate([3, 4, 10, 11, "a", "b", "1", "01"])] + [("q", 0, "3", 0, 200)], schema)
    got = {x.id: x.kept for x in deliveries(again, ["topic", "partition"], "o", "t", "id", seen=ranges, seen_odd=odd, block_numbers=8, hot_rows=hot).collect()}
    assert got == {100: False, 101: True, 102: False, 103: True, 104: False, 105: True, 106: False, 107: False, 200: True}


def test_deliveries_of_nothing(spark):
    assert deliveries(spark.createDataFrame([], "topic string, partition int, o long, t long, id long"), ["topic", "partition"], "o", "t", "id").count() == 0


TYPE = '{"attributes": [{"name": "no", "type": "string"}, {"layout": "row", "attributes": [{"layout": "group", "name": "visits", "repeatable": true, "attributes": [{"name": "at", "type": "date"}, {"layout": "group", "name": "labs", "repeatable": true, "attributes": [{"name": "v", "type": "number"}]}]}]}, {"layout": "group", "name": "site", "attributes": [{"layout": "group", "name": "rooms", "repeatable": true, "attributes": [{"name": "n", "type": "integer"}]}]}]}'
DOCS = {
    1: '{"no": "a", "visits": [{"at": "x", "labs": [{"v": 1.50}, null, {"v": 2}]}, null, {"at": null}]}',
    2: '{"visits": {"at": "y", "labs": {"v": true}}, "site": {"rooms": [{"n": 1}, 7, "z", [{"n": 2}]]}}',
    3: '{"visits": "[{\\"at\\": \\"t\\", \\"labs\\": \\"{\\\\\\"v\\\\\\": 3}\\"}]", "site": [{"rooms": [{"n": 9}]}]}',
    4: '{"visits": "no json", "other": {"deep": [1, {"x": "y"}]}}',
    5: None, 6: "", 7: "[1]", 8: '{"visits": []} x', 9: '{"visits": 3}',
}


def shredding(spark):
    types = spark.createDataFrame([(1, TYPE), (2, None), (3, "broken")], "id int, type_definition string")
    rows = spark.createDataFrame([(i, 1, d, "clash") for i, d in DOCS.items()] + [(20, 2, DOCS[1], "c"), (21, None, DOCS[1], "c")], "id long, entity_type_id int, data string, node string")
    return rows, types


def test_shred(spark):
    want = {(1, "visits[0]"), (1, "visits[0].labs[0]"), (1, "visits[0].labs[2]"), (1, "visits[2]"), (2, "visits[0]"), (2, "visits[0].labs[0]"), (2, "site.rooms[0]"), (3, "visits[0]"), (3, "visits[0].labs[0]")}
    rows, types = shredding(spark)
    table = nodes(rows, types)
    assert {(x.id, x.path) for x in elements(table).collect()} == want
    assert {(x.id, x.path) for x in shredded(rows, types).collect()} == want
    scalars = {(x.id, x.owner, x.field): x.scalar for x in table.where("kind = 'scalar'").collect()}
    assert scalars[4, 0, "other.deep[1].x"] == "y" and scalars[1, 0, "no"] == "a"
    assert shredded(rows.limit(0), types).count() == 0 and shredded(rows, types.where("id > 1")).count() == 0


def test_flat_tables_link_up(spark):
    rows, types = shredding(spark)
    tables = shredded(rows, types)
    labs = {(x.id, x.path): x for x in flat_table(tables, types, "visits.labs").collect()}
    visits = {(x.id, x.node): x for x in flat_table(tables, types, "visits").collect()}
    assert labs[1, "visits[0].labs[2]"].v == "2" and labs[1, "visits[0].labs[2]"].ordinal == 2 and labs[2, "visits[0].labs[0]"].v == "true"
    assert all(visits[i, x.parent].path == path.rsplit(".", 1)[0] for (i, path), x in labs.items())
    assert visits[1, labs[1, "visits[0].labs[0]"].parent].at == "x" and {x.at for (i, _), x in visits.items() if i == 1} == {"x", None}


def test_fields_with_names_of_columns_and_of_plain_groups(spark):
    kind = '{"attributes": [{"layout": "group", "name": "g", "repeatable": true, "attributes": [{"name": "node"}, {"name": "ID2"}, {"layout": "group", "name": "p", "attributes": [{"name": "x"}, {"layout": "group", "name": "h", "repeatable": true, "attributes": [{"name": "Node"}]}]}]}]}'
    rows = spark.createDataFrame([(1, 1, '{"g": {"node": "n", "ID2": 3, "p": {"x": "deep", "h": [{"Node": "m"}]}}}')], "id long, entity_type_id int, data string")
    types = spark.createDataFrame([(1, kind)], "id int, type_definition string")
    tables = shredded(rows, types)
    assert columns_of(types, "g") == (["ID2", "node", "p.x"], []) and columns_of(types, "g.p.h") == (["Node"], [])
    assert [tuple(x)[5:] for x in flat_table(tables, types, "g").collect()] == [("3", "n", "deep")]
    assert [tuple(x)[4:] for x in flat_table(tables, types, "g.p.h").collect()] == [("g[0].p.h[0]", "m")]


def test_sql_names_every_defined_field(spark, data):
    types = spark.read.parquet(f"{data}/entity_type.parquet")
    groups = {g for texts in types.select("type_definition").collect() for g, _, _ in fields_of((parse(texts[0]) or {}).get("attributes", []))}
    assert groups == set(problems.GROUPS) == set(problems.FIELDS)
    assert all(sum(map(list, columns_of(types, g)), []) == problems.FIELDS[g] for g in groups)


def test_repeatable_attributes_become_arrays(spark):
    kind = '{"attributes": [{"layout": "group", "name": "labs", "repeatable": true, "attributes": [{"name": "v"}, {"name": "flags", "repeatable": true}]}]}'
    labs = ['{"v": 1, "flags": ["b", "a", null, "b"]}', '{"flags": []}', '{"v": 3}', '{"v": 4, "flags": "x"}', '{"flags": null}', '{"v": 6, "other": ["z"], "flags": [' + ",".join(f'"{k}"' for k in range(12)) + "]}"]
    rows = spark.createDataFrame([(1, 1, '{"flags": ["top"], "labs": [' + ",".join(labs) + "]}")], "id long, entity_type_id int, data string")
    types = spark.createDataFrame([(1, kind)], "id int, type_definition string")
    got = {x.ordinal: (x.v, x.flags) for x in flat_table(shredded(rows, types), types, "labs").collect()}
    assert got == {0: ("1", ["b", "a", None, "b"]), 1: (None, []), 2: ("3", None), 3: ("4", ["x"]), 4: (None, None), 5: ("6", [str(k) for k in range(12)])}


def test_lab_flags_of_the_whole_table(spark, data):
    got = {(x.id, x.path): json.loads(x.flags) if x.flags else None for x in problems.queries()["p6_encounters_labs"](spark, data).collect()}
    groups = definitions([tuple(r) for r in spark.read.parquet(f"{data}/entity_type.parquet").select("id", "type_definition").collect()])
    documents = [(r.id, d) for r in spark.read.parquet(f"{data}/entity_instance.parquet").where("entity_type_id = 201").collect() if (d := parse(r.data)) is not None]
    paths = {(i, p) for i, d in documents for p in brute_elements(d, groups[201]) if ".labs[" in p and p.startswith("encounters[")}
    assert set(got) == paths

    def at(d, path):
        import json

        for name, k in re.findall(r"(\w+)\[(\d+)\]", path):
            d = json.loads(d[name]) if isinstance(d[name], str) else d[name]
            d = d[int(k)] if isinstance(d, list) else d
        return d

    for i, d in documents:
        for path in (p for j, p in paths if j == i):
            assert got[i, path] == at(d, path).get("flags")
    assert any(got.values())


def brute_elements(document, groups, path=""):
    for name, value in document.items():
        repeatable, inner = groups.get(name, (False, {}))
        at = f"{path}.{name}" if path else name
        if repeatable:
            if isinstance(value, str):
                import json

                try:
                    value = json.loads(value)
                except ValueError:
                    continue
            for k, item in enumerate(value if isinstance(value, list) else [value]):
                if isinstance(item, dict):
                    yield f"{at}[{k}]"
                    yield from brute_elements(item, inner, f"{at}[{k}]")
        elif isinstance(value, dict):
            yield from brute_elements(value, inner, at)


def test_shred_of_the_whole_table(spark, data):
    types = {r.id: r.type_definition for r in spark.read.parquet(f"{data}/entity_type.parquet").collect()}
    groups = definitions(list(types.items()))
    want = sorted((r.id, p) for r in spark.read.parquet(f"{data}/entity_instance.parquet").collect() if (d := parse(r.data)) is not None for p in brute_elements(d, groups[r.entity_type_id]))
    assert sorted(map(tuple, problems.p6_found(spark, data).collect())) == want and want


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_lookup_with_salts(spark, hot):
    rows = spark.createDataFrame([(i, "h" if i % 3 else str(i)) for i in range(60)], "id long, k string")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    assert lookup(rows, groups, ["k"], hot_rows=hot).count() == 60
    assert lookup(rows, groups.where("n > 1"), ["k"], "left_semi", hot_rows=hot).count() == 40


def test_a_million_events_in_one_block(spark):
    """One user holds all events, close together: the work is cut by count and the sessions are right."""
    events = spark.range(1_000_000).selectExpr("'u' k", "id * 1000 + (id div 100000) * 1000000 t", "id", "id % 7 u")
    table = durable(events.select(F.col("k").alias("key"), "t"))
    largest = with_blocks(table, ["key"], "t").groupBy("block").count().agg(F.max("count")).first()[0]
    assert largest < 500_000
    got = sorted((x.first_id, x.last_id, x.n) for x in sessions(events, "k", "t", "id", gap_us=10_000).collect())
    assert got == [(k * 100_000, k * 100_000 + 99_999, 100_000) for k in range(10)]
    (period,) = sweep(events.selectExpr("k", "t - t % 1000000000 a", "t + 2000000 b"), ["k"], "a", "b").where("kind = 'period'").collect()
    assert period.n == 1_000_000
