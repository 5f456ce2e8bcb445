"""Lookups as joins: domains, pseudonyms, instances, types, projects, algorithms."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilframe.functions.jsondoc import parse_any

REQUEST = ["request", "domainid", "identifier", "idtype", "psn"]


class TooManyRows(ValueError):
    """More rows than a request may return."""


def one_by_name(rows: DataFrame, names: DataFrame, name: str = "name", wanted: str = "wanted") -> DataFrame:
    """``names`` with the row of that name, letter case and surrounding blanks ignored; nulls if none or several fit.

    The table is grouped by its folded name first, so a name used twice is found by nobody and no row is repeated.
    """
    single = rows.groupBy(F.lower(name).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rows.columns)).alias("_row")).where("_n = 1")
    return names.join(single, F.lower(F.trim(wanted)) == F.col("_key"), "left").select(*names.columns, *[F.col(f"_row.{c}").alias(c) for c in rows.columns])


def in_domain(pseudonyms: DataFrame, domain_id: int) -> DataFrame:
    """All pseudonyms of one domain; pruned to its partition where the table is partitioned by domain."""
    return pseudonyms.where(F.col("domainid") == domain_id)


def export(pseudonyms: DataFrame, domain_id: int, most: int = 50_000) -> DataFrame:
    """The pseudonyms of a domain, or ``TooManyRows`` if there are more than ``most``; counting stops beyond it."""
    found = in_domain(pseudonyms, domain_id)
    if found.select(F.lit(1)).limit(most + 1).count() > most:
        raise TooManyRows(f"more than {most} pseudonyms in domain {domain_id}")
    return found


def by_identifier(requests: DataFrame, pseudonyms: DataFrame) -> DataFrame:
    """Forward lookup: every pseudonym of identifier, id type and domain."""
    return requests.join(pseudonyms, ["identifier", "idtype", "domainid"])


def by_pseudonym(requests: DataFrame, pseudonyms: DataFrame) -> DataFrame:
    """Reverse lookup by pseudonym and domain; a pseudonym held several times in the domain is found by nobody."""
    single = pseudonyms.groupBy("domainid", F.col("pseudonym").alias("psn")).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("id", "identifier", "idtype")).alias("_row")).where("_n = 1")
    return requests.select("request", "domainid", "psn").join(single, ["domainid", "psn"]).select("request", "domainid", "psn", "_row.*")


def dispatch(requests: DataFrame, pseudonyms: DataFrame) -> DataFrame:
    """Lookup by whatever is given (``request``, ``domainid``, ``identifier``, ``idtype``, ``psn``): request and id.

    With identifier and type all pseudonyms are found, with a pseudonym as well only that one; with a pseudonym alone
    the identifier is looked up. Requests with neither find nothing. The three cases are disjoint equi-joins.
    """
    has_id = F.col("identifier").isNotNull() & F.col("idtype").isNotNull()
    has_psn = F.col("psn").isNotNull()
    held = pseudonyms.select("id", "identifier", "idtype", "domainid", "pseudonym")
    forward = requests.where(has_id & ~has_psn).join(held, ["identifier", "idtype", "domainid"]).select("request", "id")
    both = requests.where(has_id & has_psn).withColumnRenamed("psn", "pseudonym").join(held, ["identifier", "idtype", "domainid", "pseudonym"]).select("request", "id")
    reverse = requests.where(~has_id & has_psn).select("request", "domainid", F.col("psn").alias("pseudonym")).join(held, ["domainid", "pseudonym"]).select("request", "id")
    return forward.unionByName(both).unionByName(reverse)


def json_equal_key(rows: DataFrame, column: str, key: str = "json_key") -> DataFrame:
    """``rows`` with the SHA-256 of a document's canonical form (names sorted, no white space, numbers by value).

    Documents that are equal as JSON have equal keys; what is no JSON has a null key.
    """
    import hashlib
    import json

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{key}` string"
    at = rows.columns.index(column)

    def run(batches):
        for batch in batches:
            keys = []
            for text in batch.column(at).to_pylist():
                value = None if text is None else parse_any(text)
                keys.append(None if value is None else hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], names=[*batch.schema.names, key])

    return rows.mapInArrow(run, schema)


def instances_by_data(instances: DataFrame, wanted: DataFrame, data: str = "wanted") -> DataFrame:
    """Live instances whose document equals a wanted one as JSON: the wanted text's row and the instance's id."""
    held = json_equal_key(instances.where("not is_deleted").select("id", "data"), "data").select("id", "json_key")
    return json_equal_key(wanted, data).join(held, "json_key").drop("json_key")


def instances_by_ids(instances: DataFrame, ids: DataFrame, type_id: int, deleted: bool = False) -> DataFrame:
    """Instances of one type among a table of ids (a semi-join, never a list), live ones unless ``deleted``."""
    rows = instances.where(F.col("entity_type_id") == type_id)
    return (rows if deleted else rows.where("not is_deleted")).join(ids.select("id").distinct(), "id", "left_semi")


def instance_by_any(requests: DataFrame, instances: DataFrame) -> DataFrame:
    """Instances by UUID where the text is one, else by equal document: ``request``, ``id``."""
    is_uuid = F.col("text").rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    live = instances.where("not is_deleted")
    by_uid = requests.where(is_uuid).withColumn("instance_uid", F.lower("text")).join(live.select("id", F.lower("instance_uid").alias("instance_uid")), "instance_uid").select("request", "id")
    by_data = instances_by_data(instances, requests.where(~is_uuid).select("request", "text"), "text").select("request", "id")
    return by_uid.unionByName(by_data)


def current_types(types: DataFrame, project_id: int | None = None, base: bool | None = None) -> DataFrame:
    """Types that aren't deprecated, of one project or (not) base types."""
    found = types.where("not is_deprecated")
    if project_id is not None:
        found = found.where(F.col("project_id") == project_id)
    return found if base is None else found.where(F.col("is_base_type") == base)


def positional(requests: DataFrame, rows: DataFrame, keys: str, key: str, value: str, result: str) -> DataFrame:
    """For an array of keys the array of values at the same positions, null where there is none.

    Each request is exploded, joined with the (small, broadcast by size) table and put together by position.
    """
    named = rows.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    exploded = requests.select("request", F.posexplode_outer(keys).alias("_at", "_k")).join(named, "_k", "left")
    return exploded.groupBy("request").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(result))


def by_values(rows: DataFrame, wanted: Mapping[str, object], order: str = "id") -> DataFrame:
    """The first row (by ``order``) that has all the values that aren't None; none are wanted: the first row."""
    tests = [F.col(k) == F.lit(v) for k, v in wanted.items() if v is not None]
    return (rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows).orderBy(order).limit(1)


def table_metrics(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each table, counted from file footers."""
    counted = [t.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counted)


def stored_bytes(table: DataFrame) -> int:
    """Bytes of the files behind a table, asked from the file system."""
    spark = table.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in table.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
