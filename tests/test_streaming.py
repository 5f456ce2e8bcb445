"""The stream gives what the batch gives, and a replay changes nothing."""

import json

from pyspark.sql import functions as F

from veilframe.streaming import ingest

MESSAGES = [
    {"identifier": "1", "idType": "T", "sourceDomain": "Base"},
    {"identifier": "1", "idType": "T", "sourceDomain": "BASE "},
    {"identifier": "2", "idType": "T", "sourceDomain": "Base", "psn": "mine", "validFrom": "2020-05-01"},
    {"identifier": "3", "idType": "T", "sourceDomain": "Base", "psn": "mine"},
    {"identifier": " ", "idType": "T", "sourceDomain": "Base"},
    {"identifier": "4", "idType": "T"},
    {"identifier": "5", "idType": "T", "sourceDomain": "Newly"},
]
DOMAIN = "id int, name string, prefix string, validfrom timestamp_ntz, validto timestamp_ntz, enforcestartdatevalidity boolean, enforceenddatevalidity boolean, algorithm string, pseudonymlength int, paddingcharacter string, salt string, addcheckdigit boolean, lengthincludescheckdigit boolean"
NOW = "timestamp_ntz'2024-01-01'"


def domains(spark):
    row = spark.range(1).selectExpr("1 id", "'Base' name", "'B-' prefix", "timestamp_ntz'2019-01-01' validfrom", "timestamp_ntz'2030-01-01' validto", "true enforcestartdatevalidity", "true enforceenddatevalidity", "'MD5' algorithm", "8 pseudonymlength", "'0' paddingcharacter", "'s' salt", "false addcheckdigit", "false lengthincludescheckdigit")
    return row.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in DOMAIN.split(", ")])


def lines():
    return [json.dumps(m) for m in MESSAGES] + ["no json", ""]


def test_batch(spark):
    messages = spark.createDataFrame([(x,) for x in lines()], "value string")
    held = spark.createDataFrame([], "domainid int, identifier string, idtype string, pseudonym string")
    results, rejects, after = ingest.batch(messages, domains(spark), held, F.expr(NOW))
    status = sorted((r.identifier, r.domainid, r.status) for r in results.collect())
    assert [(i, s) for i, d, s in status if i == "1"] == [("1", "success")]
    assert {r.identifier: r.copies for r in results.collect()} == {"1": 2, "2": 1, "3": 1, "5": 1}
    assert sorted(s for i, d, s in status if i in "23") == ["duplicate pseudonym", "success"]
    assert sorted(r.reject for r in rejects.collect()) == ["malformed", "malformed", "no domain", "no identifier"]
    made = after.where("id > 1").collect()
    assert [(r.name, r.prefix, r.id, r.algorithm, r.pseudonymlength, r.addcheckdigit, str(r.validfrom), str(r.validto)) for r in made] == [("Newly", "NE-", 2, "RANDOM_LET", 16, True, "2024-01-01 00:00:00", "2054-01-01 00:00:00")]
    assert len(made[0].salt) == 32 and all(r.pseudonym for r in results.collect())
    drawn = results.where("domainid = 2").first().pseudonym
    assert drawn.startswith("NE-") and len(drawn) == 3 + 16 + 1 and drawn[3:].isalpha()
    start = {r.identifier: str(r.validfrom) for r in results.where("domainid = 1").collect()}
    assert start["2"] == "2020-05-01 00:00:00" and start["1"] == "2019-01-01 00:00:00"


def test_stream_equals_batch_and_replays_are_harmless(spark, tmp_path):
    folder, state = tmp_path / "in", tmp_path / "state"
    folder.mkdir()
    every = lines()
    for k in range(3):  # the third file delivers the first again
        (folder / f"{k}.txt").write_text("\n".join(every[:4] if k != 1 else every[4:]))
        ingest.run(ingest.files(spark, str(folder)), str(state), str(tmp_path / "cp"), domains, F.expr(NOW)).awaitTermination(120)
    got = spark.read.parquet(str(state / "pseudonyms"))
    messages = spark.createDataFrame([(x,) for x in every], "value string")
    held = spark.createDataFrame([], "domainid int, identifier string, idtype string, pseudonym string")
    want = ingest.batch(messages, domains(spark), held, F.expr(NOW))[0].where("status = 'success'")
    columns = ["domainid", "idtype", F.when(F.col("domainid") == 1, F.col("pseudonym")).alias("pseudonym"), "validto"]
    # which of two messages with one supplied pseudonym comes first isn't fixed within a batch; new domains draw
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    assert got.where("pseudonym is null").count() == 0
    known = ingest.current_domains(domains(spark), str(state), 10)
    assert [(r.id, r.name) for r in known.orderBy("id").collect()] == [(1, "Base"), (2, "Newly")]
    refused = spark.read.parquet(str(state / "rejects"))
    assert refused.where("reject = 'duplicate pseudonym'").count() > 0  # the second "mine" isn't lost without a word
    assert refused.where("reject <> 'duplicate pseudonym'").count() == 3  # an empty line at a file's end is no message


def test_counters_go_on_over_batches(spark, tmp_path):
    """A counting domain never gives a number twice, whatever the batches, and a collision is drawn again."""
    counting = lambda s: domains(s).withColumn("algorithm", F.lit("CONSECUTIVE")).withColumn("consecutivevaluecounter", F.lit(5).cast("long"))
    folder, state = tmp_path / "in", tmp_path / "state"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.txt").write_text("\n".join(json.dumps({"identifier": f"{k}{n}", "idType": "T", "sourceDomain": "base"}) for n in range(4)))
        ingest.run(ingest.files(spark, str(folder)), str(state), str(tmp_path / "cp"), counting, F.expr(NOW)).awaitTermination(120)
    got = sorted(r.pseudonym for r in spark.read.parquet(str(state / "pseudonyms")).collect())
    assert got == [f"B-{n:08d}" for n in range(6, 18)]
    assert ingest.current_domains(counting(spark), str(state), 99).first().consecutivevaluecounter == 17


def test_kafka_source_asks_for_the_topic(spark, monkeypatch):
    """The connector isn't on the class path here; the options it gets are looked at instead."""
    from pyspark.sql.streaming import DataStreamReader

    seen = {}

    monkeypatch.setattr(DataStreamReader, "option", lambda self, k, v: seen.update({k: v}) or self)
    monkeypatch.setattr(DataStreamReader, "format", lambda self, f: seen.update(format=f) or self)
    monkeypatch.setattr(DataStreamReader, "load", lambda self: seen.update(loaded=True) or spark.range(1).selectExpr("cast('{}' as binary) value", "'t' topic", "0 partition", "1L offset"))
    got = ingest.kafka(spark, "host:9092", "psn", maxOffsetsPerTrigger="10")
    assert got.columns == ["value", "topic", "partition", "record_offset"] and got.first().value == "{}"
    assert seen == {"format": "kafka", "kafka.bootstrap.servers": "host:9092", "subscribe": "psn", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "10", "loaded": True}
