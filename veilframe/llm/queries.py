"""Queries of the problems on training data (1, 2, 5, 8, 9, 10) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.llm.lookalike import classes, clean_texts, forms, lookalikes
from veilframe.llm.matching import expand, match, membership
from veilframe.llm.packing import fill_report, mixture_report, pack
from veilframe.llm.persons import person_rows
from veilframe.llm.rewritings import rewritings
from veilframe.llm.survivors import cells, records, survivors
from veilframe.llm.tokens import decode, encode, token_counts
from veilframe.plans.durable import durable
from veilframe.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

SCOPE = ["project_id", "entity_type_id"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return rewritings(table(spark, folder, "entity_instance"), SCOPE).where("id <> first_id").select("first_id", "id")


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every repeated record once, with the number of its copies."""
    return rewritings(table(spark, folder, "entity_instance"), SCOPE).where("id = first_id").select("first_id", F.col("n").alias("copies"))


#: The field that holds the record number, by entity type.
RECORD_NUMBERS = {201: "mrn", 202: "donorNo", 203: "subjectNo", 204: "nr", 205: "specimenNo"}


def _survivors(spark: SparkSession, folder: str, weighting: str) -> DataFrame:
    return survivors(cells(table(spark, folder, "entity_instance"), table(spark, folder, "entity_type"), RECORD_NUMBERS), weighting)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _survivors(spark, folder, "recency").select("first_id", "field", "value_id")


def p2_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """Survivors when every row has one vote."""
    return _survivors(spark, folder, "majority")


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    """One surviving record per record number, as JSON, with the row that gave each value."""
    return records(_survivors(spark, folder, "recency")).select("first_id", F.to_json("record").alias("record"), F.to_json("sources").alias("sources"))


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows that describe the same person in different projects, with the confidence of the match."""
    rows = durable(person_rows(table(spark, folder, "entity_instance")))
    return expand(match(rows), rows)


def p5_links(spark: SparkSession, folder: str) -> DataFrame:
    """The compact form of p5_pairs: one row per row of a matched record, with its ``person`` (the smallest id among the
    matched records' rows) and ``links``, the number of rows in other projects it is paired with."""
    rows = durable(person_rows(table(spark, folder, "entity_instance")))
    return membership(match(rows), rows)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pairs(spark, folder).select("id_a", "id_b")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"))


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose decoded tokens differ from their text; there must be none."""
    documents = table(spark, folder, "documents")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("original"))
    return decode(encode(documents)).join(texts, "doc_id").where("text <> original").select("doc_id")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(token_counts(table(spark, folder, "documents"), ["doc_id", "source"]), table(spark, folder, "token_container"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each document (or piece of one) for each kind of container."""
    return _packed(spark, folder)


def p9_filled(spark: SparkSession, folder: str) -> DataFrame:
    return fill_report(_packed(spark, folder), table(spark, folder, "token_container"))


def p9_windows(spark: SparkSession, folder: str) -> DataFrame:
    """How far each window of documents is from the target mixture, source by source."""
    return mixture_report(durable(_packed(spark, folder)))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes(table(spark, folder, "documents"))


def p10_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in the one form."""
    return forms(table(spark, folder, "documents"))


def p10_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The compact form of p10_found: each document that has a look-alike, with its text, its class and its links."""
    return classes(table(spark, folder, "documents"))


def p10_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The text to be used of each document: one form, each word in its own alphabet."""
    return clean_texts(table(spark, folder, "documents")).select("doc_id", "clean")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_records, p2_found, p2_consensus, p2_records, p5_found, p5_pairs, p5_links, p8_ids, p8_roundtrip, p9_containers, p9_filled, p9_windows, p10_found, p10_forms, p10_classes, p10_clean)}


#: SQL of problems 1 and 2: every leaf of every document, with texts in plain form.
_PLAIN = r"replace(regexp_replace(lower({0}), '[\s\p{{P}}\p{{Z}}\x1c-\x1f\x85]', '', 'g'), 'ß', 'ss')"
_LEAVES = """o as materialized (select id, project_id, entity_type_id, is_deleted, updated_at, data::json d from entity_instance where json_valid(data) and json_type(data) = 'OBJECT'),
l as (select o.id, o.project_id, o.entity_type_id, o.is_deleted, o.updated_at, t.fullkey, t.type, case when t.type = 'VARCHAR' then json_extract_string(t.atom, '$') else t.value::varchar end v from o, json_tree(o.d) t where t.type not in ('OBJECT', 'ARRAY') or t.value::varchar in ('{}', '[]'))"""
_COPIES = f"with {_LEAVES}, k as (select id, project_id, entity_type_id, md5(string_agg(fullkey || ' ' || type || ' ' || case when type = 'VARCHAR' then {_PLAIN.format('v')} else coalesce(v, 'null') end, chr(10) order by fullkey)) k from l group by all), g as (select *, min(id) over w first_id, count(*) over w n from k window w as (partition by project_id, entity_type_id, k))"
_NUMBER = "case {0} " + " ".join(f"when {k} then '{v}'" for k, v in RECORD_NUMBERS.items()) + " end"
_SURVIVORS = f"""with {_LEAVES}, r as (select id, project_id, entity_type_id, {_PLAIN.format('v')} n from l where fullkey = '$.' || {_NUMBER.format('entity_type_id')} and type <> 'NULL'),
g as (select *, min(id) over w first_id, count(*) over w n_rows from r where n <> '' window w as (partition by project_id, entity_type_id, n)),
s as (select g.first_id, substr(l.fullkey, 3) field, l.id, l.updated_at, l.type, l.v from l join g using (id) where n_rows > 1 and not coalesce(l.is_deleted, false) and l.type <> 'NULL' and not contains(l.fullkey, '[') and l.v not in ('{{}}', '[]')
  and split_part(substr(l.fullkey, 3), '.', 1) not in ('encounters', 'consents', 'diagnoses', 'biosamples', 'visits', 'befragungen', 'steps') and substr(l.fullkey, 3) <> {_NUMBER.format('g.entity_type_id')})
select first_id, field, arg_max(id, (coalesce(epoch_us(updated_at), -9223372036854775808), id)) value_id from s where type <> 'VARCHAR' or {_PLAIN.format('v')} not in ('', 'na', 'ka', 'unknown', 'unbekannt', 'nichtbekannt', 'keineangabe', 'notknown', '00000', '19000101', '01011900') group by 1, 2"""
#: The form once more, sign by sign, for the SQL that checks it; nothing here is shared with the operator.
_LIKE = {
    "АВЕЅІЈКМНОРСТХԚԜӀаеорсухѕіјԁһԛԝЇїЁёЀѐӒӓӐӑӖӗӦӧӱ": "ABESIJKMHOPCTXQWIaeopcyxsijdhqwÏïËëÈèÄäĂăĔĕÖöÿ",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹαγινορυϲϳμΆΈΊΌΎΪΫάίόύϊϋΐΰ": "ABEZHIKMNOPTYXCayivopucjµÁÉÍÓÝÏŸáíóúïüḯǘ",
    "ԼՍՏՕագզհյոսցօ": "LUSOɯqqhjnugo",
}


def _form_sql(text: str = "text") -> str:
    pairs = ", ".join(f"'{a}': '{b}'" for some, others in _LIKE.items() for a, b in zip(some, others))
    u = "unicode(c)"
    hidden = " or ".join(f"{u} between {a} and {b}" for a, b in [(0, 8), (14, 31), (127, 132), (134, 159), (173, 173), (847, 847), (1564, 1564), (6068, 6069), (6155, 6159), (8203, 8207), (8234, 8238), (8288, 8303), (65024, 65039), (65279, 65279), (917504, 921599)])
    plain = f"case when {hidden} then '' when {u} between 65281 and 65374 then chr({u} - 65248) when regexp_matches(c, '\\p{{Zs}}') then ' ' else c end"
    chars = lambda t: f"regexp_extract_all({t}, '(?s).')"
    first = f"nfc_normalize(array_to_string(list_transform({chars(text)}, lambda c: {plain}), ''))"
    return f"nfc_normalize(array_to_string(list_transform({chars(first)}, lambda c: coalesce(map {{{pairs}}}[c], c)), ''))"


def oracle_sql() -> dict[str, str]:
    """SQL where it can say it; the other queries are tested against brute force."""
    visible = "regexp_matches(form, '[^\\s\\x{85}\\x{2028}\\x{2029}]')"
    formed = f"with f as (select doc_id, text, {_form_sql()} as form from documents where text is not null), v as (select * from f where {visible})"
    texts = ", t as (select form, text, count(*) n, min(doc_id) text_id from v group by 1, 2), k as (select form, min(text_id) class_id, sum(n) documents from t group by 1 having count(*) > 1)"
    return {
        "p1_found": _COPIES + " select first_id, id from g where id <> first_id",
        "p1_records": _COPIES + " select first_id, n copies from g where id = first_id and n > 1",
        "p2_found": _SURVIVORS,
        "p8_roundtrip": "select doc_id from documents where false",
        "p10_forms": f"select doc_id, {_form_sql()} as form from documents",
        "p10_found": formed + " select a.doc_id doc_id_a, b.doc_id doc_id_b from v a join v b on a.form = b.form and a.text <> b.text and a.doc_id < b.doc_id",
        "p10_classes": formed + texts + " select v.doc_id, text_id, class_id, (documents - n)::bigint links from v join t using (form, text) join k using (form)",
    }
