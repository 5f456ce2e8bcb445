"""The facade: a working day on a small copy of the tables."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from veilframe.engine import Engine, Linkage
from veilframe.functions.jsonpath import descend
from veilframe.operators import classify, creation, entities, linkage as L


@pytest.fixture()
def engine(spark, data):
    return Engine(spark, data, F.expr("timestamp'2024-06-01 00:00:00'"))


def test_pseudonyms(spark, engine, tmp_path):
    d = engine.domains.where("algorithm = 'MD5' and not multiplepsnallowed").orderBy("id").first()
    asks = spark.createDataFrame([(1, "new-1", "T", d.id), (2, "new-2", "T", d.id), (3, "new-1", "T", d.id)], "request long, identifier string, idtype string, domainid int")
    before = engine.pseudonyms.count()
    got = {r.request: r for r in engine.create_pseudonyms(asks).collect()}
    assert [got[k].status for k in (1, 2, 3)] == [classify.SUCCESS, classify.SUCCESS, classify.SAME_IDENTIFIER]
    assert got[1].pseudonym.startswith(d.prefix) and engine.pseudonyms.count() == before + 2
    again = engine.create_pseudonyms(asks)
    assert {r.status for r in again.collect()} == {classify.SAME_IDENTIFIER}
    found = engine.get_pseudonyms(asks.withColumn("psn", F.lit(None).cast("string"))).collect()
    assert {r.identifier for r in found} == {"new-1", "new-2"}
    gone = found[0]
    flags = engine.delete_pseudonyms(spark.createDataFrame([(1, gone.identifier, gone.idtype, gone.pseudonym, gone.domainid)], "request int, identifier string, idtype string, pseudonym string, domainid int"))
    assert flags.first().deleted and engine.pseudonyms.count() == before + 1
    engine.save(str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/pseudonym.parquet").count() == before + 1
    assert engine.search_pseudonyms("*", d.id)[0].count() <= 30


def test_every_kind_of_domain_makes_pseudonyms(spark, engine):
    kinds = {a: engine.domains.where((F.col("algorithm") == a) & (F.col("validto") > F.lit("2024-06-01").cast("timestamp_ntz"))).orderBy("id").first() for a in ("RANDOM_LET", "CONSECUTIVE", "XXHASH", "SHA2")}
    asks = spark.createDataFrame([(k, f"brand-new-{k}", "T", d.id) for k, d in enumerate(kinds.values())] + [(50, "x", "T", 10_000)], "request long, identifier string, idtype string, domainid int")
    got = {r.request: r for r in engine.create_pseudonyms(asks).collect()}
    assert all(got[k].status == classify.SUCCESS and got[k].pseudonym.startswith(d.prefix) for k, d in enumerate(kinds.values())) and got[50].status == creation.UNKNOWN_DOMAIN
    d = kinds["CONSECUTIVE"]
    assert engine.domains.where(f"id = {d.id}").first().consecutivevaluecounter == d.consecutivevaluecounter + 1
    row = engine.pseudonyms.where("identifier = 'brand-new-3'").first()
    changes = spark.createDataFrame([(row.id, "renamed")], "id long, new_identifier string")
    (changed,) = engine.complete_update(changes).collect()
    assert changed.id == row.id and changed.pseudonym != row.pseudonym and changed.pseudonym.startswith(kinds["SHA2"].prefix)


def test_domain_updates_reach_pseudonyms(spark, engine):
    d = engine.domains.where("superdomainid is null").orderBy("id").first()
    engine.tables["grant"] = spark.createDataFrame([("u", "DOMAIN", d.id, "domain:read"), ("u", "PROJECT", d.id, "project:read")], "subject_id string, resource_type string, resource_id int, action string")
    inherited = engine.pseudonyms.where(f"domainid = {d.id} and validtoinherited")
    n = inherited.count()
    engine.update_domain(d.id, validto=datetime.datetime(2047, 1, 1))
    assert engine.pseudonyms.where(f"domainid = {d.id} and validtoinherited and validto = timestamp_ntz'2047-01-01'").count() == n > 0
    engine.delete_domain(d.name)
    assert [r.resource_type for r in engine.tables["grant"].collect()] == ["PROJECT"]


def test_creating_an_entity_is_one_operation(spark, engine):
    """Validated, linked, stored, named and indexed; the index knows the new one at once."""
    fields = lambda rows: rows.select("id", F.get_json_object("data", "$.specimenNo").alias("no"))
    rules = [L.Rule("no", tag="t", blocking=("exact",), weight=5.0)]
    config = L.Config(min_score=1.0, min_normalized=0.5, auto_link=True, on_match="returnExisting")
    index = L.tokens(fields(engine.instances.where("entity_type_id = 205").limit(20)), rules, {"no": "no"}, config)
    link = Linkage(rules, {"no": "no"}, fields, index, config)
    home = engine.domains.where("algorithm = 'MD5'").orderBy("id").first()
    engine.tables["entity_type"] = engine.types.withColumn("associated_domain_id", F.when(F.col("id") == 205, F.lit(home.id)).otherwise(F.col("associated_domain_id")))
    document = lambda no, kind: json.dumps({"specimenNo": no, "kind": kind, "collected": "2020-01-01T00:00:00Z"})
    schema = "request long, project_id int, entity_type_id int, data string"
    got = {r.request: r for r in engine.create_instances(spark.createDataFrame([(1, 12, 205, document("SPX-1", "DNA")), (2, 12, 205, "{}")], schema), link).collect()}
    assert got[1].status == "created" and got[1].pseudonym.startswith(home.prefix) and got[2].status == "rejected" and got[2].id is None
    row = engine.instances.where(F.col("id") == got[1].id).first()
    assert engine.pseudonyms.where(F.col("identifier") == row.instance_uid).first().pseudonym == got[1].pseudonym
    again = {r.request: r for r in engine.create_instances(spark.createDataFrame([(7, 12, 205, document("spx-1 ", "RNA"))], schema), link).collect()}
    assert again[7].status == "returned" and again[7].id == got[1].id and again[7].pseudonym is None


def test_domains(spark, engine):
    d = engine.domains
    parent = d.where("superdomainid is null").orderBy("id").first()
    asks = spark.createDataFrame([(1, "Brand-New", "BN-", parent.id), (2, parent.name.upper(), "X-", None)], "request int, name string, prefix string, parent int").withColumn("algorithm", F.lit(None).cast("string"))
    assert {r.request: r.status for r in engine.create_domains(asks, {"algorithm": F.lit("RANDOM_LET")}).collect()} == {1: "created", 2: "duplicate"}
    made = engine.domains.where("name = 'Brand-New'").first()
    assert made.algorithm == parent.algorithm and made.algorithminherited and made.superdomainid == parent.id
    engine.update_domain(parent.id, algorithm="SHA1")
    assert engine.domains.where("name = 'Brand-New'").first().algorithm == "SHA1"
    assert len(engine.new_salt(parent.id, 20)) == 20
    engine.delete_domain(parent.name)
    assert engine.domains.where("name = 'Brand-New'").count() == 0 and engine.domains.count() < d.count()
    assert engine.domain_hierarchy().count() == engine.domains.count()


def test_links(engine):
    names = {r.id: r.name for r in engine.domains.collect()}
    parent = engine.domains.where("superdomainid is not null").orderBy("id").first()
    pairs = engine.linked_pseudonyms(names[parent.superdomainid], parent.name, F.col("domainid") == parent.superdomainid)
    assert pairs.count() >= 0 and engine.linked_pseudonyms("nobody", parent.name, F.lit(True)).count() == 0


def test_instances(spark, engine):
    good = {"specimenNo": "SP1", "kind": "DNA", "collected": "2020-01-01T00:00:00Z"}
    asks = spark.createDataFrame([(1, 12, 205, json.dumps(good)), (2, 12, 205, json.dumps(dict(reversed(good.items())))), (3, 12, 205, "{}"), (4, 12, 205, "x")], "request long, project_id int, entity_type_id int, data string")
    assert {r.request: r.status for r in engine.create_instances(asks).collect()} == {1: "created", 2: "duplicate", 3: "rejected", 4: "rejected"}
    new = engine.instances.where("data like '%SP1%'").select("id", "instance_uid").collect()
    assert len(new) == 1
    asked = spark.createDataFrame([(7, new[0].instance_uid), (8, json.dumps(good))], "request int, text string")
    assert {(r.request, r.id) for r in engine.get_instances(asked).collect()} == {(7, new[0].id), (8, new[0].id)}
    engine.delete_instances(spark.createDataFrame([(new[0].id,)], "id long"))
    assert engine.get_instances(asked).count() == 0


def test_the_rest(spark, engine):
    assert engine.metrics().count() == 6 and engine.running_projects().count() > 0
    people = spark.createDataFrame([(1, "anna"), (2, "anna")], "id long, name string")
    rules = [L.Rule("n", tag="t", blocking=("exact",), weight=5.0)]
    assert [(r.query, r.id) for r in engine.record_linkage(people.where("id = 1"), people, rules, {"n": "name"}).collect()] == [(1, 2)]
    engine.clear("audit_event")
    assert engine.tables["audit_event"].count() == 0
    asks = spark.createDataFrame([("t",)], "topic string").selectExpr("timestamp_ntz'2024-01-01' request_time", "'u' user_name", "null forwarded", "null real_ip", "null remote", "null url", "null query", "'{ }' body", "topic", "1 partition", "2L record_offset")
    engine.record_audit(asks.select(*[F.col(c).cast("string") if t == "void" else F.col(c) for c, t in asks.dtypes]))
    assert engine.tables["audit_event"].first().request_body == "{}"
    engine.retain_audit(1)
    assert engine.tables["audit_event"].count() == 0


def test_json_paths():
    document = {"a": [{"b": [1, {"c": "x"}]}, {"b": {"c": ["y", None, " ", True]}}, 3], "d": {"e": 5}}
    assert descend(document, ["a", "b", "c"]) == ["x", "y", "true"] and descend(document, ["d"]) == [] and descend(document, ["d", "e"]) == ["5"] and descend(document, ["q"]) == []


def test_images(spark):
    rows = spark.createDataFrame([(1, bytearray(b"x"), "image/PNG"), (2, bytearray(b""), "image/png"), (3, bytearray(b"x"), None), (4, None, "image/png"), (5, bytearray(5 * 1024 * 1024 + 1), "image/png")], "id int, data binary, mime string")
    assert {r.id: r.reason for r in entities.usable_images(rows).select("id", "reason").collect()} == {1: None, 2: "empty", 3: "wrong type", 4: "empty", 5: "too large"}


def test_tables_of_a_database(spark):
    """Through the embedded database that comes with Spark: read whole, and in ranges of a key."""
    from veilframe.sources.tables import jdbc

    url, driver = "jdbc:derby:memory:veil;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.range(100).selectExpr("id", "concat('n', id) name")
    rows.write.format("jdbc").option("url", url).option("dbtable", "things").option("driver", driver).mode("overwrite").save()
    whole = jdbc(spark, url, "things", driver=driver)
    parts = jdbc(spark, url, "things", key="id", bounds=(0, 100), partitions=4, driver=driver)
    assert whole.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() == 4
    want = {(r.id, r.name) for r in rows.collect()}
    assert {(r[0], r[1]) for r in whole.collect()} == {(r[0], r[1]) for r in parts.collect()} == want


def test_algorithms(spark):
    table = spark.createDataFrame([(1, "MD5", 5)], "id int, name string, consecutivevaluecounter long")
    table, new = entities.get_or_create_algorithm(table, {"name": "SHA1"})
    assert new and not entities.get_or_create_algorithm(table, {"name": "SHA1"})[1]
    table, found = entities.update_algorithm(table, 1, consecutivevaluecounter=6)
    assert found and table.where("id = 1").first().consecutivevaluecounter == 6 and not entities.update_algorithm(table, 9, name="x")[1]
    table, gone = entities.delete_algorithm(table, 2)
    assert gone and [r.id for r in table.collect()] == [1]


def test_without_a_shared_folder_a_cluster_is_refused():
    from veilframe.plans.durable import shared_folder

    class Conf(dict):
        def get(self, name, default=None):
            return dict.get(self, name, default)

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(RuntimeError):
        shared_folder(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert shared_folder(Session()) == "hdfs:///shared"


def test_durable_tables_go_when_told(spark):
    import os

    from veilframe.plans.durable import durable, release, temporary

    where = lambda t: t._durable_path.removeprefix("file://")
    kept = durable(spark.range(3))
    with temporary(spark):
        inner = durable(kept)
        with temporary(spark):
            innermost = durable(kept)
        assert not os.path.exists(where(innermost)) and os.path.exists(where(inner)) and inner.count() == 3
    assert not os.path.exists(where(inner)) and kept.count() == 3
    release(kept, None, spark.range(1))
    assert not os.path.exists(where(kept))
