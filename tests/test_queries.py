"""Every query runs; those with SQL agree with it."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle import connect, same_rows

CORE = {n: f for m in (entry.pseudonyms, entry.records, entry.problems) for n, f in m.queries().items()}
SQL = {n: s for m in (entry.pseudonyms, entry.records, entry.problems) for n, s in m.oracle_sql().items()}


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


def test_names_match():
    assert set(SQL) <= set(CORE)
    assert set(CORE) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, data, duck, name):
    same_rows(CORE[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_rows(spark, data, name):
    """What the queries without SQL must at least keep to; their values are tested by themselves."""
    table = "customer" if name.startswith(("psn_", "pprl_stored")) else None
    df = CORE[name](spark, data)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    if table:  # one row per row of the table, none without a value
        assert len(rows) == spark.read.parquet(f"{data}/{table}.parquet").count()
        assert all(v is not None for r in rows for v in r)
    if name == "pprl_stored":
        assert all(r.same for r in rows)
    if name == "pprl_linkage":
        best = {}
        for r in rows:
            assert 0 < r.normalized <= 1 and r.score >= 2.0 and r.query != r.id
            best.setdefault(r.query, []).append((r.rank, -r.normalized))
        assert all(sorted(v) == sorted(v, key=lambda x: x[0]) and sorted(k for k, _ in v) == list(range(1, len(v) + 1)) for v in best.values())
    if name.startswith("psn_random"):
        assert len({r.psn for r in rows}) == len(rows)
