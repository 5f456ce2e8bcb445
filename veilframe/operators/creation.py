"""Creating pseudonyms in their domains: validity, making or taking over, classification, retries, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.functions.normalize import blank
from veilframe.functions.validity import clamp_end, clamp_start, wanted_end
from veilframe.operators import classify, pseudonymize
from veilframe.plans.durable import durable, release

UNKNOWN_DOMAIN, EXPIRED, NO_PSEUDONYM = "unknown domain", "domain expired", "no pseudonym"
#: How often a drawn pseudonym is drawn in all before a collision stands (fixed value).
ATTEMPTS = 3
VALIDITY = ["validfrom", "validfrominherited", "validto", "validtoinherited"]


def with_validity(requests: DataFrame, domains: DataFrame, as_of: Column) -> DataFrame:
    """``requests`` (``domainid``; optional ``given_from``, ``given_to``, ``period``) with the pseudonym's validity
    within its domain's, ``multiple`` (whether the domain allows several pseudonyms of an identifier), ``drawing``,
    ``prefix`` and ``reject``: an unknown domain, or one that has ended by ``as_of``."""
    optional = lambda name, kind: F.col(name) if name in requests.columns else F.lit(None).cast(kind)
    d = pseudonymize.settings(domains).select("domainid", F.col("_p").alias("prefix"), F.col("_m").alias("multiple"), F.coalesce(F.col("_a").isin(pseudonymize.DRAWING), F.lit(False)).alias("drawing"))
    bounds = domains.select(F.col("id").alias("domainid"), F.col("validfrom").alias("_from"), F.col("validto").alias("_to"), F.col("enforcestartdatevalidity").alias("_es"), F.col("enforceenddatevalidity").alias("_ee"))
    joined = requests.join(d.join(bounds, "domainid"), "domainid", "left")
    start, start_inherited = clamp_start(optional("given_from", "timestamp_ntz"), F.col("_from"), F.col("_es"))
    joined = joined.withColumn("validfrom", start).withColumn("validfrominherited", start_inherited)
    joined = joined.withColumn("_wanted", wanted_end(optional("given_to", "timestamp_ntz"), optional("period", "string"), F.col("validfrom")))
    end, end_inherited = clamp_end(F.col("_wanted"), F.col("_to"), F.col("_ee"))
    joined = joined.withColumn("validto", end).withColumn("validtoinherited", end_inherited)
    reject = F.when(F.col("multiple").isNull(), UNKNOWN_DOMAIN).when(F.col("_to") < as_of.cast("timestamp_ntz"), EXPIRED)
    return joined.withColumn("reject", reject).drop("_from", "_to", "_es", "_ee", "_wanted")


def create(requests: DataFrame, domains: DataFrame, held: DataFrame, as_of: Column, add_prefix: bool = True, seed: int | None = None, attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """Creates pseudonyms for ``requests``: ``request`` (unique), ``identifier``, ``idtype``, ``domainid``; optional
    ``given`` (the caller's own pseudonym), ``given_from``, ``given_to``, ``period``. Returns the requests with
    ``pseudonym``, validity and ``status``, and the domains with their counters advanced.

    Requests of unknown or ended domains, and those without a pseudonym (no identifier, type or algorithm), get that
    as status and are never stored; the others end as success or as a duplicate (see ``classify.create``; several
    pseudonyms of an identifier are allowed where the domain says so). A given pseudonym gets the domain's prefix
    unless it has it (``add_prefix``). Drawn pseudonyms that collide are drawn again, ``attempts`` times in all.

    What an attempt made is written out before it is classified, since counting or drawing anew would change it.
    """
    given = F.when(~blank(F.col("given")), F.trim("given")) if "given" in requests.columns else F.lit(None).cast("string")
    rows = with_validity(requests, domains, as_of).withColumn("_given", given)
    if add_prefix:
        rows = rows.withColumn("_given", pseudonymize.supplied(F.col("_given"), F.col("prefix")))
    make = F.col("reject").isNull() & F.col("_given").isNull()
    ready = durable(rows)
    out = [*requests.columns, "pseudonym", *VALIDITY, "status"]

    def drawn(some: DataFrame, number: int) -> DataFrame:
        return durable(pseudonymize.by_domain(some, domains, "pseudonym", "request", None if seed is None else seed + number))

    made = drawn(ready.where(make), 0)
    counted = pseudonymize.advanced(domains, made.where("pseudonym is not null").select("domainid"))
    named = made.unionByName(ready.where("reject is null and _given is not null").withColumn("pseudonym", F.col("_given")))
    waiting, known, tables = named.where("pseudonym is not null"), held.select(*classify.FULL_KEY), []
    done = ready.where("reject is not null").withColumn("pseudonym", F.lit(None).cast("string")).withColumn("status", F.col("reject")).select(*out)
    done = done.unionByName(made.where("pseudonym is null").withColumn("status", F.lit(NO_PSEUDONYM)).select(*out))
    again = (F.col("status") == classify.SAME_PSEUDONYM) & F.col("drawing") & F.col("_given").isNull()
    for attempt in range(1, attempts + 1):
        results = durable(classify.create(waiting, classify.near(known, waiting), "multiple"))
        tables.append(results)
        if attempt == attempts or results.where(again).isEmpty():
            done = done.unionByName(results.select(*out))
            break
        done = done.unionByName(results.where(~again).select(*out))
        known = known.unionByName(results.where(F.col("status") == classify.SUCCESS).select(*classify.FULL_KEY))
        waiting = drawn(results.where(again).drop("pseudonym", "status"), attempt)
        tables.append(waiting)
    finished, after = durable(done), durable(counted)
    release(ready, made, *tables)
    return finished, after
