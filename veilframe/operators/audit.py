"""The audit trail: building events, user types, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BODY_BYTES = 4096
#: User types by descending precedence with the group that gives them.
USER_TYPES = {"HUMAN": "human-users", "TECHNICAL": "technical-users", "ALL": "audit-everything", "NONE": "no-auditing"}


def user_type(groups: Column, names: dict[str, str] | None = None) -> Column:
    """The first type whose group (written with a leading slash) is among the groups; UNKNOWN if none is."""
    chosen = F.lit("UNKNOWN")
    for kind, group in reversed((names or USER_TYPES).items()):
        chosen = F.when(F.array_contains(groups, f"/{group}"), kind).otherwise(chosen)
    return F.when(groups.isNull(), "UNKNOWN").otherwise(chosen)


def audited(kind: Column, wanted: Column) -> Column:
    """Whether a user's events are kept: always for ALL, never for NONE, else if the operation audits the type."""
    return (kind == "ALL") | ((kind != "NONE") & F.array_contains(wanted, kind))


def payload(body: Column, most: int = BODY_BYTES) -> Column:
    """The first ``most`` bytes of a body in UTF-8, marked if there were more, without white space. Of a sign cut in two
    a replacement character is left."""
    cut = F.make_valid_utf8(F.substring(F.encode(body, "utf-8"), 1, most).cast("string"))
    text = F.when(F.octet_length(body) > most, F.concat(cut, F.lit("..."))).otherwise(body)
    return F.regexp_replace(text, r"\s+", "")


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def requester(*candidates: Column) -> Column:
    """Who asked: the first that isn't blank of token subject, context subject and audit name, else KAFKA or UNKNOWN."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in candidates], F.lit("UNKNOWN"))


def client_ip(forwarded: Column, real: Column, remote: Column) -> Column:
    """The first address of the forwarding header, else the proxy's header, else the connection's address."""
    known = lambda c: F.when((F.trim(c) != "") & (F.lower(F.trim(c)) != "unknown"), F.trim(c))
    return F.coalesce(known(F.substring_index(forwarded, ",", 1)), known(real), remote)


def build(requests: DataFrame) -> DataFrame:
    """Requests and stream messages as audit events.

    A row with a topic is a message: it has topic, partition and offset but no URL; others are REST requests, whose
    URL gets its query back. Names are resolved by ``requester``, bodies by ``payload``.
    """
    message = F.col("topic").isNotNull()
    url = F.when(~message, F.concat(F.col("url"), F.when(F.coalesce("query", F.lit("")) != "", F.concat(F.lit("?"), F.col("query"))).otherwise("")))
    name = F.coalesce(F.when(F.trim("user_name") != "", F.col("user_name")), F.when(message, F.lit("KAFKA")), F.lit("UNKNOWN"))
    return requests.select("request_time", name.alias("user_name"), F.when(~message, client_ip(F.col("forwarded"), F.col("real_ip"), F.col("remote"))).alias("requester_ip"), url.alias("request_url"), payload(F.col("body")).alias("request_body"), F.when(message, "KAFKA").otherwise("REST").alias("source_system"), "topic", F.when(message, F.col("partition")).alias("partition"), F.when(message, F.col("record_offset")).alias("record_offset"))


def retained(events: DataFrame, as_of: Column, days: int = 3650) -> DataFrame:
    """Events not older than ``days`` before ``as_of``; events without a time stay. A table partitioned by day needs
    only the filter pushed to its partitions."""
    return events.where(F.col("request_time").isNull() | (F.col("request_time") >= as_of - F.make_dt_interval(F.lit(days))))
