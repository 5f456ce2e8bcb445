"""Ingesting pseudonymisation messages as a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from veilframe.functions.luhn import SALT_CHARACTERS
from veilframe.functions.normalize import blank
from veilframe.functions.validity import parse, plus
from veilframe.operators.classify import SUCCESS
from veilframe.operators.creation import VALIDITY, create
from veilframe.operators.pseudonymize import numbered, random_text
from veilframe.plans.durable import durable, temporary

#: The settings of a domain that a message brings into being.
DOMAIN_DEFAULTS = {
    "enforcestartdatevalidity": True, "enforceenddatevalidity": True, "algorithm": "RANDOM_LET", "alphabet": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "randomalgorithmdesiredsize": 100_000_000, "randomalgorithmdesiredsuccessprobability": 0.99999998, "multiplepsnallowed": False, "pseudonymlength": 16,
    "paddingcharacter": "0", "addcheckdigit": True, "lengthincludescheckdigit": False, "consecutivevaluecounter": 0, "saltlength": 32,
}
DOMAIN_YEARS = "30 years"


@dataclass(frozen=True)
class Fields:
    """Names of the fields in a message."""

    identifier: str = "identifier"
    idtype: str = "idType"
    psn: str = "psn"
    domain: str = "sourceDomain"
    valid_from: str = "validFrom"
    valid_to: str = "validTo"
    validity: str = "validityTime"
    user: str = "username"


def kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """The topic as a stream of ``value`` texts from the earliest offset; needs the Kafka connector on the class path.
    Offsets live in the query's checkpoint, which takes the place of acknowledgements."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load().select(F.col("value").cast("string").alias("value"), "topic", "partition", F.col("offset").alias("record_offset"))


def files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A folder of text files, one message per line, as a stream."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder)


def parsed(messages: DataFrame, fields: Fields = Fields(), value: str = "value") -> DataFrame:
    """``messages`` with the fields of each JSON message under our names and ``reject``: why a message can't be used
    (malformed, no identifier, type or domain), null if it can."""
    m = F.from_json(F.col(value), "map<string,string>", {"mode": "PERMISSIVE"})
    named = {"identifier": fields.identifier, "idtype": fields.idtype, "psn": fields.psn, "domain": fields.domain, "valid_from": fields.valid_from, "valid_to": fields.valid_to, "validity": fields.validity, "user_name": fields.user}
    rows = messages.withColumn("_m", m).select("*", *[F.try_element_at("_m", F.lit(f)).alias(n) for n, f in named.items()], (F.col("_m").isNull() | (F.size("_m") == 0)).alias("_bad")).drop("_m")
    reason = F.when(F.col("_bad"), "malformed").when(blank(F.col("identifier")), "no identifier").when(blank(F.col("idtype")), "no type").when(blank(F.col("domain")), "no domain")
    return rows.withColumn("reject", reason).drop("_bad")


def new_domains(rows: DataFrame, domains: DataFrame, as_of: Column, seed: int | None = None) -> DataFrame:
    """A domain for each unknown domain name (case ignored): prefix of its first two signs and a hyphen, the settings of
    ``DOMAIN_DEFAULTS``, nothing inherited, a salt of its own, valid from the earliest start a message gives (now, if
    none does or it lies ahead) for thirty years. Ids follow the greatest in use, by name."""
    usable = rows.where("reject is null").select(F.trim("domain").alias("name"), parse(F.col("valid_from")).cast("timestamp_ntz").alias("_start"))
    names = usable.groupBy(F.lower("name").alias("_l")).agg(F.min("name").alias("name"), F.min("_start").alias("_start"))
    unknown = names.join(domains.select(F.lower("name").alias("_l")), "_l", "left_anti").drop("_l")
    top = domains.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    now = as_of.cast("timestamp_ntz")
    row = numbered(unknown, ["name"], top, "id").withColumn("validfrom", F.when(F.col("_start") <= now, F.col("_start")).otherwise(now))
    row = row.withColumn("validto", plus(F.col("validfrom"), F.lit(DOMAIN_YEARS))).withColumn("prefix", F.concat(F.upper(F.substring("name", 1, 2)), F.lit("-")))
    row = row.withColumn("salt", random_text(F.lit(SALT_CHARACTERS), F.lit(DOMAIN_DEFAULTS["saltlength"]), seed))
    made = {"id", "name", "validfrom", "validto", "prefix", "salt"}
    value = lambda c: F.col(c) if c in made else F.lit(False) if c.endswith("inherited") else F.lit(DOMAIN_DEFAULTS.get(c))
    return row.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in domains.schema])


def requested(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """Usable messages as creation requests, messages of one content as one with the number of ``copies``: ``request``
    (128 bits of the content), ``identifier``, ``idtype``, ``domainid``, ``given``, ``given_from``, ``given_to``,
    ``period``. Copies are counted before the shuffle, so a message sent very often costs no more than another."""
    names = domains.groupBy(F.lower("name").alias("_l")).agg(F.min("id").alias("domainid"))
    content = rows.where("reject is null").select("identifier", "idtype", F.lower(F.trim("domain")).alias("_l"), F.when(~blank(F.col("psn")), F.trim("psn")).alias("given"), "valid_from", "valid_to", F.col("validity").alias("period"))
    counted = content.groupBy(*content.columns).agg(F.count(F.lit(1)).alias("copies"))
    request = F.md5(F.to_json(F.struct(*content.columns))).alias("request")
    return counted.join(names, "_l", "left").select(request, "identifier", "idtype", "domainid", "given", parse(F.col("valid_from")).cast("timestamp_ntz").alias("given_from"), parse(F.col("valid_to")).cast("timestamp_ntz").alias("given_to"), "period", "copies")


def batch(messages: DataFrame, domains: DataFrame, held: DataFrame, as_of: Column, fields: Fields = Fields(), seed: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One batch of messages: (requests with ``pseudonym``, validity and ``status``; rejected messages; the domains,
    with those that messages brought into being and with counters advanced).

    Every domain's own algorithm applies, supplied pseudonyms are taken as they are (no prefix), drawn ones that
    collide are drawn again. Messages of one content within the batch are one request; delivered again later they find
    their identifier held and are duplicates, so in domains with one pseudonym per identifier a replay changes nothing.
    ``held`` (full key) is read once per attempt, as far as it meets the batch's keys (see ``classify.near``).
    """
    rows = durable(parsed(messages, fields))  # three readers
    fresh = durable(new_domains(rows, domains, as_of, seed))
    every = domains.unionByName(fresh)
    # parsed dates are columns from here on; as expressions they would be repeated in every comparison
    asked = durable(requested(rows, every))
    results, after = create(asked, every, held, as_of, add_prefix=False, seed=seed)
    return results, rows.where("reject is not null").select("value", "reject"), after


#: What the stream keeps of a pseudonym.
STORED = "domainid int, identifier string, idtype string, pseudonym string, validfrom timestamp_ntz, validfrominherited boolean, validto timestamp_ntz, validtoinherited boolean"


def _stored(spark: SparkSession, path: str, schema, before: int) -> DataFrame | None:
    """What batches before this one wrote to a folder, with their number; None if there is nothing yet."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(schema).parquet(path).where(F.col("batch") < before)


def current_domains(domains: DataFrame, state: str, before: int) -> DataFrame:
    """The domains as the stream left them: those given, replaced and joined by the latest version of each it wrote."""
    written = _stored(domains.sparkSession, f"{state}/domains", T.StructType([*domains.schema.fields, T.StructField("batch", T.LongType())]), before)
    if written is None:
        return domains
    row = F.struct(*domains.columns).alias("r")
    every = domains.select(F.lit(-1).cast("long").alias("batch"), row).unionByName(written.select("batch", row))
    return every.groupBy(F.col("r.id").alias("_id")).agg(F.max_by("r", "batch").alias("r")).select("r.*")


def run(messages: DataFrame, state: str, checkpoint: str, domains: Callable[[SparkSession], DataFrame], as_of: Column, trigger: dict | None = None, fields: Fields = Fields()):
    """Starts the stream: each micro-batch is classified against the pseudonyms under ``state``/pseudonyms; its
    successes, rejects and the domains it made or counted on are written under ``state`` by batch number.

    A batch that runs again after a failure overwrites its own number and never sees its own former rows. State is
    laid out by batch and domain; of the history only rows that meet a key of the batch leave the scan. Intermediate
    tables go with the batch. One writer per state folder.
    """

    def each(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        with temporary(spark):
            held = _stored(spark, f"{state}/pseudonyms", STORED + ", batch long", number)
            held = spark.createDataFrame([], STORED) if held is None else held.drop("batch")
            known = durable(current_domains(domains(spark), state, number))
            results, rejects, after = batch(durable(rows), known, held, as_of, fields=fields)
            kept = ["domainid", "identifier", "idtype", "pseudonym", *VALIDITY]
            results.where(F.col("status") == SUCCESS).select(*kept).write.mode("overwrite").partitionBy("domainid").parquet(f"{state}/pseudonyms/batch={number}")
            refused = results.where(~F.col("status").isin(SUCCESS, "duplicate identifier")).select(F.to_json(F.struct("identifier", "idtype", "domainid", "given")).alias("value"), F.col("status").alias("reject"))
            rejects.unionByName(refused).write.mode("overwrite").parquet(f"{state}/rejects/batch={number}")
            counter = F.col("consecutivevaluecounter") if "consecutivevaluecounter" in known.columns else F.lit(0)
            same = known.select("id", F.coalesce(counter, F.lit(-1)).alias("_n"))
            changed = after.join(same, "id", "left").where(F.col("_n").isNull() | (F.col("_n") != F.coalesce(counter, F.lit(-1)))).drop("_n")
            changed.write.mode("overwrite").parquet(f"{state}/domains/batch={number}")

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
