"""Queries of the general problems (3, 4, 6, 7) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.functions.text import blank, strip
from veilframe.operators.delivery import deliveries, seen_ranges
from veilframe.operators.intervals import sweep
from veilframe.operators.sessions import sessions, sessions_with_values
from veilframe.operators.shred import flat_table, shredded
from veilframe.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

ENTITY = ["identifier", "idtype", "domainid"]
MESSAGE = ["topic", "partition"]


def micros(name: str):
    """Microseconds since 1970 of a timestamp without zone."""
    return F.unix_micros(F.col(name).cast("timestamp"))


def _validity(spark: SparkSession, folder: str) -> DataFrame:
    return sweep(table(spark, folder, "pseudonym").select(*ENTITY, micros("validfrom").alias("a"), micros("validto").alias("b")), ENTITY, "a", "b")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _validity(spark, folder).where("kind = 'gap' or n >= 2").select(*ENTITY, "kind", "from_us", "to_us")


def p3_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Every continuous period with the number of rows that formed it, and every gap."""
    return _validity(spark, folder).select(*ENTITY, "kind", "from_us", "to_us", "n")


def _deliveries(spark: SparkSession, folder: str) -> DataFrame:
    return deliveries(table(spark, folder, "audit_event"), MESSAGE, "record_offset", "request_time", "id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _deliveries(spark, folder).where("not kept").select("id")


def p4_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The one row kept of each message."""
    return _deliveries(spark, folder).where("kept").select(*MESSAGE, F.col("number").alias("record_offset"), "id")


def p4_seen_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """What a following batch needs to know: the ranges of offsets seen, per producer."""
    return seen_ranges(_deliveries(spark, folder), MESSAGE)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all flat tables."""
    return shredded(table(spark, folder, "entity_instance"), table(spark, folder, "entity_type")).select("id", "path")


def _flat(group: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        types = table(spark, folder, "entity_type")
        # documents of types that don't define the group have no row in its table
        flat = flat_table(shredded(table(spark, folder, "entity_instance"), types), types, group)
        above = F.regexp_extract("path", r"^(.*\])\.[^\[\]]*\[\d+\]$", 1)
        columns = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() == "array" else f.name for f in flat.schema if f.name not in ("id", "path", "node", "parent")]
        return flat.select("id", "path", F.when(above != "", above).alias("parent_path"), *columns)

    query.__doc__ = f"The flat table of group {group}; a row's parent is the row of ``id`` and ``parent_path``."
    return query


#: The repeatable groups of the entity types and the type that defines each; fields come from the definitions.
GROUPS = {
    "encounters": 201, "encounters.diagnoses": 201, "encounters.labs": 201, "consents": 201, "diagnoses": 201, "biosamples": 202, "biosamples.aliquots": 202, "biosamples.aliquots.moves": 202,
    "visits": 203, "visits.forms": 203, "visits.forms.items": 203, "befragungen": 204, "befragungen.antworten": 204, "steps": 205, "steps.readings": 205,
}


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "audit_event").where(~blank(F.col("request_url")))
    return rows.select(F.lower(strip(F.col("user_name"))).alias("user_name"), micros("request_time").alias("t"), "id", "request_url").where("user_name not in ('', 'unknown')")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return sessions(_requests(spark, folder), "user_name", "t", "id").select(F.col("key").alias("user_name"), "first_id", "last_id")


def p7_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with start, end, duration, number of requests and of distinct URLs."""
    found = sessions_with_values(_requests(spark, folder), "user_name", "t", "id", "request_url")
    return found.select(F.col("key").alias("user_name"), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), F.col("n").alias("requests"), F.col("distinct_values").alias("urls"))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {f.__name__: f for f in (p3_found, p3_periods, p4_found, p4_messages, p4_seen_ranges, p6_found, p7_found, p7_sessions)}
    return found | {f"p6_{group.replace('.', '_')}": _flat(group) for group in GROUPS}


_ISLANDS = """
with v as (select id, identifier, idtype, domainid, epoch_us(validfrom) a, epoch_us(validto) b from pseudonym
           where validto > validfrom and identifier is not null and idtype is not null and domainid is not null),
m as (select *, max(b) over (partition by identifier, idtype, domainid order by a, b, id rows between unbounded preceding and 1 preceding) upto from v),
g as (select *, sum(case when upto is null or a > upto then 1 else 0 end) over (partition by identifier, idtype, domainid order by a, b, id rows unbounded preceding) island from m),
p as (select identifier, idtype, domainid, island, min(a) a, max(b) b, count(*) n from g group by all),
q as (select *, lead(a) over (partition by identifier, idtype, domainid order by island) next_a from p)
"""
_KEPT = """
with m as (select *, row_number() over (partition by topic, partition, record_offset order by request_time nulls last, id) k from audit_event
           where topic is not null and partition is not null and record_offset is not null)
"""
_REQUESTS = r"""
with r as (select lower(regexp_replace(user_name, '^[\s\x{a0}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{a0}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')) user_name,
                  epoch_us(request_time) t, id, request_url from audit_event
           where request_url is not null and trim(request_url, e' \t\r\n') <> '' and request_time is not null),
u as (select * from r where user_name not in ('', 'unknown')),
s as (select *, case when t - lag(t) over (partition by user_name order by t, id) <= 1800000000 then 0 else 1 end fresh from u),
n as (select *, sum(fresh) over (partition by user_name order by t, id rows unbounded preceding) session from s)
"""


#: What the SQL below expects the definitions to say; a test compares them.
FIELDS = {
    "encounters": ["admitted", "no", "ward"], "encounters.diagnoses": ["certainty", "code"], "encounters.labs": ["test", "unit", "value", "flags"], "consents": ["granted", "module", "since"], "diagnoses": ["certainty", "code"],
    "biosamples": ["barcode", "material", "taken"], "biosamples.aliquots": ["pos", "vol"], "biosamples.aliquots.moves": ["at", "to"],
    "visits": ["date", "visit"], "visits.forms": ["form"], "visits.forms.items": ["a", "q"], "befragungen": ["datum", "welle"], "befragungen.antworten": ["frage", "wert"],
    "steps": ["at", "operator", "step"], "steps.readings": ["k", "v"],
}


def _group_sql(group: str) -> str:
    """CTEs of which the last, ``t<depth>``, has a row per element of the group: id, v (the object), path, above, ordinal."""
    names = group.split(".")
    parts = [f"t0 as (select id, data::json v, null::varchar path from entity_instance where entity_type_id = {GROUPS[group]} and json_valid(data) and json_type(data) = 'OBJECT')"]
    for k, name in enumerate(names):
        parts.append(f"c{k} as (select id, path, json_extract(v, '$.\"{name}\"') c from t{k})")
        parts.append(f"s{k} as (select id, path, case when json_type(c) <> 'VARCHAR' then c when json_valid(json_extract_string(c, '$')) then json_extract_string(c, '$')::json end c from c{k})")
        parts.append(f"l{k} as (select id, path, case json_type(c) when 'ARRAY' then json_extract(c, '$[*]') when 'OBJECT' then [c] end l from s{k})")
        parts.append(f"u{k} as (select id, path above, unnest(l) v, generate_subscripts(l, 1) - 1 ordinal from l{k})")
        parts.append(f"t{k + 1} as (select id, v, above, ordinal::int ordinal, coalesce(above || '.', '') || '{name}[' || ordinal || ']' path from u{k} where json_type(v) = 'OBJECT')")
    return ", ".join(parts)


def _flat_sql(group: str) -> str:
    at = lambda f: f"json_extract(v, '$.\"{f}\"')"
    text = lambda v: f"case when json_type({v}) not in ('OBJECT', 'ARRAY', 'NULL') then json_extract_string({v}, '$') end"
    several = lambda v: f"case when json_type({v}) = 'ARRAY' then to_json(json_extract_string({v}, '$[*]'))::varchar when json_type({v}) not in ('OBJECT', 'NULL') then to_json([json_extract_string({v}, '$')])::varchar end"
    columns = ", ".join(f"{(several if f == 'flags' else text)(at(f))} as \"{f}\"" for f in FIELDS[group])
    return f"with {_group_sql(group)} select id, path, above parent_path, ordinal, {columns} from t{group.count('.') + 1}"


def oracle_sql() -> dict[str, str]:
    flat = {f"p6_{g.replace('.', '_')}": _flat_sql(g) for g in GROUPS}
    return flat | {
        "p6_found": " union all ".join(f"select id, path from ({sql})" for sql in flat.values()),
        "p3_found": _ISLANDS + "select identifier, idtype, domainid, 'period' kind, a from_us, b to_us from p where n >= 2 union all select identifier, idtype, domainid, 'gap', b, next_a from q where next_a is not null",
        "p3_periods": _ISLANDS + "select identifier, idtype, domainid, 'period' kind, a from_us, b to_us, n from p union all select identifier, idtype, domainid, 'gap', b, next_a, null from q where next_a is not null",
        "p4_found": _KEPT + "select id from m where k > 1",
        "p4_messages": _KEPT + 'select topic, "partition", record_offset, id from m where k = 1',
        "p4_seen_ranges": _KEPT + ', n as (select distinct topic, "partition", record_offset o, record_offset // 65536 b from m where record_offset >= 0), r as (select *, o - row_number() over (partition by topic, "partition", b order by o) run from n) select topic, "partition", min(o) low, max(o) + 1 high from r group by topic, "partition", b, run',
        "p7_found": _REQUESTS + "select user_name, arg_min(id, (t, id)) first_id, arg_max(id, (t, id)) last_id from n group by user_name, session",
        "p7_sessions": _REQUESTS + "select user_name, min(t) start_us, max(t) end_us, max(t) - min(t) duration_us, count(*) requests, count(distinct request_url) urls from n group by user_name, session",
    }
