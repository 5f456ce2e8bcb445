"""Queries on linkage, documents, permissions, the audit trail, entities and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.functions import fulltext, normalize as N, pprl as B
from veilframe.functions.phonetics import encode_distinct
from veilframe.operators import audit, entities, linkage as L, lookup, permissions as M, present, schema, search
from veilframe.plans.durable import durable
from veilframe.plans.skew import lookup as salted_lookup
from veilframe.queries.registry import Registry
from veilframe.sources.tables import table
from veilframe.streaming import ingest

query = Registry()
queries, oracle_sql = query.queries, query.oracle_sql

AS_OF = "2025-06-01 00:00:00"


def moment():
    return F.expr(f"timestamp'{AS_OF}'")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.col("c_mktsegment"), F.lit(" "), (F.col("c_nationkey") % 7).cast("string")).alias("segment"), F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") % 997).cast("int")), "yyyy-MM-dd").alias("birth"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def instances(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entity_instance")


def types(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entity_type")


def projects(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "project")


# Normalisation, phonetics, full text

_UML = "replace(replace(replace(replace(replace(replace(replace({0}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue')"
_TRIM = r"regexp_replace({0}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@query("select doc_id, case when regexp_matches(n, '[^\\s\\p{Z}]') then n end normal from (select doc_id, " + _UML.format("regexp_replace(regexp_replace(lower(" + _TRIM.format("text") + "), '[\\t\\n\\x0b\\f\\r ]+', ' ', 'g'), '[!-/:-@\\[-`{-~]', '', 'g')") + " n from documents)")
def norm_pipeline(spark, folder):
    return documents(spark, folder).select("doc_id", N.normalize(F.col("text"), ["trim", "lower", "collapseWhitespace", "removePunctuation", "umlautFold"]).alias("normal"))


@query("select doc_id, regexp_replace(text, '[^0-9]', '', 'g') digits from documents")
def digits_only(spark, folder):
    return documents(spark, folder).select("doc_id", N.RULES["digitsOnly"](F.col("text")).alias("digits"))


_JAMO = "case when unicode(c) between 44032 and 55203 then chr(4352 + (unicode(c) - 44032) // 588) || chr(4449 + (unicode(c) - 44032) % 588 // 28) || case when (unicode(c) - 44032) % 28 > 0 then chr(4519 + (unicode(c) - 44032) % 28) else '' end else c end"


@query(f"select doc_id, array_to_string(list_transform(regexp_extract_all(strip_accents(text), '(?s).'), lambda c: {_JAMO}), '') folded from documents")
def ascii_fold(spark, folder):
    """Canonical decomposition without marks (so Korean syllables stay in their parts)."""
    return documents(spark, folder).select("doc_id", N.ascii_fold("text").alias("folded"))


@query("select p_partkey, case when length(p_name) >= 3 then substr(p_name, 1, 3) end p3, case when length(p_name) >= 4 then substr(p_name, 1, 4) end p4, case when length(p_name) >= 6 then substr(p_name, 1, 6) end p6 from part")
def prefix_blocks(spark, folder):
    return table(spark, folder, "part").select("p_partkey", *[N.prefix_block(F.col("p_name"), n).alias(f"p{n}") for n in (3, 4, 6)])


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') iso, strftime(o_orderdate, '%Y') as \"year\", strftime(o_orderdate, '%Y-%m') as \"month\" from orders")
def date_blocks(spark, folder):
    text = F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("+01:00"))
    return table(spark, folder, "orders").select("o_orderkey", N.iso_date(text).alias("iso"), N.year_block(text).alias("year"), N.year_month_block(text).alias("month"))


def _phonetic(encoder: str, name: str):
    def run(spark, folder):
        words = documents(spark, folder).select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
        return encode_distinct(words, "word", encoder, "code")

    run.__name__ = name
    run.__doc__ = f"The {encoder} code of every word of every text, each different word encoded once."
    return query()(run)


_phonetic("cologne", "phonetic_cologne")
_phonetic("doubleMetaphone", "phonetic_dm")


_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query("select doc_id, len(list_distinct(" + _WORDS.format("text") + ")) words, coalesce(len(list_filter(" + _WORDS.format("text") + ", lambda w: starts_with(w, 'pseudo'))) > 0, false) pseudo from documents where text is not null")
def fulltext_prefix(spark, folder):
    words = fulltext.lexemes(F.col("text"))
    return documents(spark, folder).where("text is not null").select("doc_id", F.size(words).cast("bigint").alias("words"), fulltext.prefix_matches(words, "Pseudo").alias("pseudo"))


_GRAMS = "list_distinct(flatten(list_transform(" + _WORDS + ", lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"with g as (select p_partkey, {_GRAMS.format('p_name')} a, {_GRAMS.format('p_type')} b from part) select p_partkey, case when len(list_distinct(list_concat(a, b))) > 0 then len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double else 0 end alike from g")
def trigram_similarity(spark, folder):
    return table(spark, folder, "part").select("p_partkey", fulltext.similarity(F.col("p_name"), F.col("p_type")).alias("alike"))


# Linkage

RULES = [
    L.Rule("person.name", tag="name.full", encoders=("cologne",), blocking=("exact", "prefix6"), weight=2.0),
    L.Rule("person.segment", tag="generic.segment", blocking=("exact", "prefix4"), weight=1.0),
    L.Rule("person.birth", kind="date", tag="date.birth", normalizers=(), blocking=("exact", "year", "yearMonth"), weight=3.0),
]
PLAIN = [L.Rule(r.path, r.kind, r.tag, r.normalizers, (), r.blocking, r.weight) for r in RULES]
COLUMNS = {"person.name": "name", "person.segment": "segment", "person.birth": "birth"}
EXACT = [L.Rule("person.name", tag="name.full", blocking=("exact",), weight=2.0), L.Rule("person.segment", tag="generic.segment", blocking=(), weight=1.0), L.Rule("person.birth", kind="date", tag="date.birth", normalizers=(), blocking=("exact",), weight=3.0)]

_CUST = "with c as (select c_custkey id, c_name as name, c_mktsegment || ' ' || (c_nationkey % 7)::varchar segment, strftime(date '1950-01-01' + (c_custkey % 997)::int, '%Y-%m-%d') birth from customer), n as (select id, lower(trim(name)) as name, lower(trim(segment)) segment, birth from c)"
_T = "select id, '{path}' field_path, '{tag}' tag, '{kind}' token_type, {value} token_value, {weight}::double weight from n where {value} is not null"


def _tokens_sql(rules: list[L.Rule]) -> str:
    out = []
    for r in rules:
        c = COLUMNS[r.path]
        prefix = lambda k: f"case when length({c}) >= {k} then substr({c}, 1, {k}) end"  # noqa: B023, E731
        values = {"exact": c, "prefix4": prefix(4), "prefix6": prefix(6), "year": f"substr({c}, 1, 4)", "yearMonth": f"substr({c}, 1, 7)"}
        for kind, value in [("norm", c), *(("block", values[b]) for b in r.blocking)]:
            out.append(_T.format(path=r.path, tag=r.tag, kind=kind, value=value, weight=r.weight))
    return " union all ".join(out)


@query(_CUST + " " + _tokens_sql(PLAIN))
def tokens_plain(spark, folder):
    return L.tokens(customers(spark, folder), PLAIN, COLUMNS).drop("bits")


@query()
def tokens_phonetic(spark, folder):
    """Tokens with phonetic codes; the codes are tested by themselves."""
    return L.tokens(customers(spark, folder), RULES, COLUMNS).drop("bits")


@query(_CUST + f", t as ({_tokens_sql(PLAIN)}), u as (select * replace (case when field_path = 'person.segment' then 'name.full' else tag end as tag, case when field_path = 'person.segment' then 'x' else token_value end as token_value) from t) select id, tag, token_type, token_value, arg_min(weight, list_position(['person.name', 'person.segment', 'person.birth'], field_path)) weight from u group by all")
def index_dedup(spark, folder):
    """One token per record, tag, type and value when two fields share a tag."""
    made = L.tokens(customers(spark, folder), PLAIN, COLUMNS)
    same = F.col("field_path") == "person.segment"
    shared = made.withColumn("tag", F.when(same, "name.full").otherwise(F.col("tag"))).withColumn("token_value", F.when(same, "x").otherwise(F.col("token_value")))
    return L.deduplicated(shared, PLAIN).select("id", "tag", "token_type", "token_value", "weight")


@query(_CUST + f", t as ({_tokens_sql(PLAIN)}) select * from t where id % 2 = 1 union all select id, field_path, tag, token_type, upper(token_value), weight from t where id % 2 = 0")
def index_rebuild(spark, folder):
    made = L.tokens(customers(spark, folder), PLAIN, COLUMNS).drop("bits")
    fresh = made.where("id % 2 = 0").withColumn("token_value", F.upper("token_value"))
    return L.rebuild_index(made, fresh)


#: Every twentieth record asks, against all records; the token sets are those of the exact rules.
_ASK = _CUST + f", t as (select distinct * from ({_tokens_sql(EXACT)})), q as (select * from t where id % 20 = 0), v as (select q.id query, t.id, count(distinct (t.tag, t.token_value)) votes from q join t using (tag, token_type, token_value) where token_type = 'block' and q.id <> t.id group by 1, 2)"


def _asked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    index = durable(L.tokens(customers(spark, folder), EXACT, COLUMNS))
    return index.where("id % 20 = 0"), index


@query(_ASK + " select * from v")
def block_candidates(spark, folder):
    return L.candidates(*_asked(spark, folder), limit=None)


@query(_ASK + " select query, id, votes from (select *, row_number() over (partition by query order by votes desc, id) k from v) where k <= 3")
def block_votes(spark, folder):
    return L.candidates(*_asked(spark, folder), limit=3)


_SCORES = _ASK + ", s as (select v.query, v.id, a.field_path, a.field_path || ' [' || a.tag || ', NORM]' why, max(a.weight) w from v join t a on a.id = v.query join t b on b.id = v.id and a.field_path = b.field_path and a.tag = b.tag and a.token_type = b.token_type and a.token_value = b.token_value where a.token_type = 'norm' group by all), r as (select query, id, sum(w) score, sum(w) / 6.0 normalized, string_agg(why, '; ' order by why) matched_on from s group by 1, 2)"


@query(_SCORES + " select query, id, score, normalized, matched_on from r")
def linkage_scores(spark, folder):
    asked, index = _asked(spark, folder)
    return L.scored(L.candidates(asked, index, limit=None), asked, index).withColumn("matched_on", F.array_join("matched_on", "; "))


CONFIG = L.Config(min_score=3.0, min_normalized=0.5, limit=1000, auto_link=True, on_match="returnExisting")


@query(_SCORES + ", f as (select *, row_number() over (partition by query order by normalized desc, score desc, id) rank from r where score >= 3 and normalized >= 0.5) select query, id, score, normalized, case when id % 10 = 7 then 'DELETED' else 'ACTIVE' end status, rank from f where rank <= 2")
def linkage_topk(spark, folder):
    asked, index = _asked(spark, folder)
    deleted = customers(spark, folder).where("id % 10 = 7").select("id")
    return L.find(asked, index, CONFIG, deleted, limit=2).drop("matched_on")


@query(_SCORES + ", f as (select *, row_number() over (partition by query order by normalized desc, score desc, id) rank from r where score >= 3 and normalized >= 0.5) select n.id query, case when f.id is null then 'created' when f.id % 10 = 7 then 'conflict' else 'returned' end action, case when f.id % 10 <> 7 then f.id end id from n left join f on f.query = n.id and rank = 1 where n.id % 20 = 0")
def auto_link(spark, folder):
    asked, index = _asked(spark, folder)
    deleted = customers(spark, folder).where("id % 10 = 7").select("id")
    requests = customers(spark, folder).where("id % 20 = 0").select(F.col("id").alias("query"))
    return L.auto_link(requests, L.find(asked, index, CONFIG, deleted), CONFIG)


@query(_CUST + ", s as (select id query from n where id % 20 = 0) select query, 6.0::double possible from s")
def best_possible(spark, folder):
    return L.best_possible(_asked(spark, folder)[0])


# Privacy-preserving linkage

SECRET = B.Pprl("correct horse battery staple", length=512, positions=4)


def _pad(b: int) -> str:
    return "".join(f"{k ^ b:02x}" for k in SECRET.secret.encode().ljust(64, b"\0"))


def _hmac_sql(message: str) -> str:
    return f"sha256(from_hex('{_pad(0x5c)}') || from_hex(sha256(from_hex('{_pad(0x36)}') || encode({message}))))"


def _context(category: str, value: str) -> str:
    return f"'veilframe|pprl|v1|1|7|name.full|{category}|' || {value}"


_GRAM = "list_distinct(list_transform(range(1, length('^' || name || '$')), lambda i: substr('^' || name || '$', i, 2)))"


@query("select c_custkey, rtrim(translate(to_base64(from_hex(" + _hmac_sql(_context("exact", "lower(c_name)")) + ")), '+/', '-_'), '=') token from customer")
def pprl_hmac_exact(spark, folder):
    one = F.lit(1)
    return table(spark, folder, "customer").select("c_custkey", B.exact_token(SECRET, one, F.lit(7), F.lit("name.full"), F.lower("c_name")).alias("token"))


@query(f"with c as (select c_custkey, lower(c_name) as name from customer) select c_custkey, array_to_string(list_sort({_GRAM}), ' ') grams from c")
def pprl_ngrams(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", F.array_join(F.array_sort(B.ngrams(F.lower("c_name"), 2)), " ").alias("grams"))


_BITS = f"""with c as (select distinct lower(c_name) as name from customer), g as (select name, unnest({_GRAM}) gram from c), h as (select name, {_hmac_sql(_context("ngram", "gram || '|' || i::varchar"))} h from g, range(0, 4) r(i)),
b as (select name, list_sort(list_distinct(list((((('0x' || substr(h, 1, 8))::bigint % 512) + 512) % 512)::int))) bits from h group by 1)"""


_BANDS = _BITS + f""", w as (select name, k::int k, array_to_string(list_transform(range(k * 32, k * 32 + 32), lambda i: case when list_contains(bits, i::int) then '1' else '0' end), '') t from b, range(0, 16) r(k))
select c_custkey, k, rtrim(translate(to_base64(from_hex({_hmac_sql(_context("band", "k::varchar || '|' || t"))})), '+/', '-_'), '=') token from customer join w on w.name = lower(c_name) where contains(t, '1')"""


@query(_BITS + " select c_custkey, array_to_string(bits, ',') bits from customer join b on b.name = lower(c_name)")
def pprl_bloom_positions(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", F.lower("c_name").alias("v"))
    return B.bloom_by_value(rows, SECRET, F.lit(1), F.lit(7), F.lit("name.full"), "v").select("c_custkey", F.array_join(F.col("bloom").cast("array<string>"), ",").alias("bits"))


@query(_BITS + " select x.c_custkey, 2.0 * len(list_intersect(p.bits, q.bits)) / (len(p.bits) + len(q.bits)) alike from customer x join customer y on y.c_custkey = x.c_custkey + 1 join b p on p.name = lower(x.c_name) join b q on q.name = lower(y.c_name)")
def pprl_dice(spark, folder):
    """Similarity of every customer's name with that of the next customer."""
    rows = table(spark, folder, "customer").select("c_custkey", F.lower("c_name").alias("v"))
    bloomed = durable(B.bloom_by_value(rows, SECRET, F.lit(1), F.lit(7), F.lit("name.full"), "v"))
    following = bloomed.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("bloom").alias("other"))
    return bloomed.join(following, "c_custkey").select("c_custkey", B.dice(F.col("bloom"), F.col("other")).alias("alike"))


@query(_BANDS.replace("select c_custkey, k,", "select c_custkey,"))
def pprl_bands(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", F.lower("c_name").alias("v"))
    bloomed = B.bloom_by_value(rows.select("v").distinct(), SECRET, F.lit(1), F.lit(7), F.lit("name.full"), "v")
    tokens = bloomed.select("v", F.explode(B.band_tokens(SECRET, F.lit(1), F.lit(7), F.lit("name.full"), F.col("bloom"))).alias("token"))
    return rows.join(tokens, "v").select("c_custkey", "token")


@query()
def pprl_stored(spark, folder):
    """Bloom filters in their stored form and back again; the two agree for every row."""
    some = table(spark, folder, "customer").select("c_custkey", F.lower("c_name").alias("v"))
    b = B.bloom_by_value(some, SECRET, F.lit(1), F.lit(7), F.lit("name.full"), "v").withColumn("stored", B.encode_bits(512)("bloom"))
    return b.select("c_custkey", "stored", (B.decode_bits("stored") == F.col("bloom")).alias("same"))


@query()
def pprl_linkage(spark, folder):
    """Candidates and scores over protected tokens only; every record asks, and every candidate is scored."""
    rules = [L.Rule("person.segment", tag="generic.segment", encoders=("doubleMetaphone",), blocking=("bloomBands", "phonetic"), weight=1.0), L.Rule("person.birth", kind="date", tag="date.birth", normalizers=(), blocking=("exact",), weight=3.0)]
    config = L.Config(private=True, pprl=SECRET, min_score=2.0, min_normalized=0.5, limit=None)
    index = durable(L.tokens(customers(spark, folder), rules, COLUMNS, config, 1, 7))
    return L.find(index, index, config).select("query", "id", "score", "normalized", "rank")


# Documents in JSON

_OK = "json_valid(data)"


@query("select id, case when json_valid(data) then json_extract_string(data, '$.contact.zip') end zip from entity_instance where entity_type_id = 201 and json_valid(data)")
def json_path_extract(spark, folder):
    rows = instances(spark, folder).where("entity_type_id = 201").select("id", "data").where(F.try_parse_json("data").isNotNull())
    return rows.select("id", F.element_at(L.values_at("data", "contact.zip"), 1).alias("zip"))


@query("select id from entity_instance where json_valid(data) and json_extract_string(data, '$.status') = 'active' and json_extract_string(data, '$.person.sex') = 'f' and json_type(data, '$.status') = 'VARCHAR'")
def json_contains(spark, folder):
    rows = instances(spark, folder).select("id", "data").where(F.try_parse_json("data").isNotNull())
    return search.contains_json(rows, {"status": "active", "person.sex": "f"}).select("id")


#: A key of each document that is JSON, the same for equal ones: every leaf with its path, type and value, in order.
_JSON_KEYS = """o as materialized (select *, data::json d from entity_instance where json_valid(data) and json_type(data) <> 'NULL'),
l as (select o.id, t.fullkey || ' ' || t.type || ' ' || coalesce(t.value::varchar, 'null') v from o, json_tree(o.d) t where t.type not in ('OBJECT', 'ARRAY') or t.value::varchar in ('{}', '[]')),
k as (select id, md5(string_agg(v, chr(10) order by v)) k from l group by 1)"""


@query("with " + _JSON_KEYS + " select i.id, min(i.id) over (partition by k) first_id from entity_instance i join k using (id)")
def json_key(spark, folder):
    """Every JSON document with the first one that is equal to it, by the canonical key."""
    keyed = durable(lookup.json_equal_key(instances(spark, folder).select("id", "data"), "data").where("json_key is not null").select("id", "json_key"))
    first = keyed.groupBy("json_key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return salted_lookup(keyed, first, ["json_key"]).select("id", "first_id")


@query("with " + _JSON_KEYS + " select w.id wanted_id, i.id from entity_instance i join k using (id) join k x on x.k = k.k join entity_instance w on w.id = x.id where not i.is_deleted and w.id % 20 = 0")
def instances_by_data(spark, folder):
    """Live instances with the same document, whatever its layout, as each twentieth row asks for."""
    rows = instances(spark, folder)
    return lookup.instances_by_data(rows, rows.where("data is not null and id % 20 = 0").select(F.col("id").alias("wanted_id"), F.col("data").alias("wanted"))).select("wanted_id", "id")


@query()
def instance_validate(spark, folder):
    """Every instance checked against its type's definition; the checks are tested one by one."""
    return schema.validate(instances(spark, folder), types(spark, folder)).select("id", F.size("errors").alias("n"), F.array_join(F.slice("errors", 1, 3), "; ").alias("first_errors"))


@query("with d as (select id, case when json_valid(data) and json_type(data) = 'OBJECT' then json_keys(data) end k from entity_instance where entity_type_id = 205) select id, array_to_string(list_sort(list_filter(['specimenNo'], lambda x: not list_contains(k, x))), ',') missing, array_to_string(list_sort(list_filter(k, lambda x: not list_contains(['specimenNo', 'kind', 'collected', 'container', 'quality', 'steps'], x))), ',') as unknown from d where k is not null")
def instance_top_level(spark, folder):
    import json

    text = types(spark, folder).where("id = 205").select("type_definition").first()[0]
    rows = instances(spark, folder).where("entity_type_id = 205").select("id", "data").where(F.try_parse_json("data").isNotNull())
    return schema.top_level_errors(rows, json.loads(text)).select("id", F.array_join("missing", ",").alias("missing"), F.array_join("unknown", ",").alias("unknown"))


@query("with " + _JSON_KEYS + ", h as (select project_id, entity_type_id, k, min(id) existing from entity_instance join k using (id) where id % 2 = 0 and not is_deleted group by 1, 2, 3), r as (select i.id, project_id, entity_type_id, k, row_number() over (partition by project_id, entity_type_id, k order by i.id) nth from entity_instance i left join k using (id)) select r.id request, case when r.k is null then 'rejected' when existing is not null or nth > 1 then 'duplicate' else 'created' end status, existing from r left join h on h.project_id = r.project_id and h.entity_type_id = r.entity_type_id and h.k = r.k")
def instance_dedup(spark, folder):
    """Creating every instance anew where the live ones of even id are held: which is created, which is a duplicate of a
    held one or of an earlier request, which is no JSON."""
    rows = instances(spark, folder)
    requests = rows.select(F.col("id").alias("request"), "project_id", "entity_type_id", "data")
    return entities.create_instances(requests, rows.where("id % 2 = 0 and not is_deleted")).select("request", "status", "existing")


@query("select id, sha256(data) data_sha256 from entity_instance")
def instance_digest(spark, folder):
    return entities.derived(instances(spark, folder)).select("id", "data_sha256")


@query("select id from entity_instance where not is_deleted order by updated_at desc nulls last, created_at desc nulls last, instance_uid limit 250")
def search_instances_star(spark, folder):
    return search.instances(instances(spark, folder), "*", most=250).select("id")


_STRINGS = "j as (select id, data::json d from entity_instance where json_valid(data)), s as (select id, array_to_string(list_transform(list_filter(json_extract(d, '$..*'), lambda x: json_type(x) = 'VARCHAR'), lambda x: json_extract_string(x, '$')), ' ') t from j)"


@query("with " + _STRINGS + ", w as (select id, list_sort(list_distinct(" + _WORDS.format("t") + ")) l from s) select id, len(l) words, md5(array_to_string(l, ' ')) digest from w")
def instance_lexemes(spark, folder):
    """The lexemes of all strings in a document, escapes undone: their number and a digest of them."""
    words = F.array_sort(fulltext.lexemes(fulltext.json_text(F.col("data"))))
    rows = instances(spark, folder).select("id", words.alias("l")).where("l is not null")
    return rows.select("id", F.size("l").cast("bigint").alias("words"), F.md5(F.array_join("l", " ")).alias("digest"))


@query("with " + _STRINGS + ", w as (select id, " + _WORDS.format("t") + " l from s) select i.id from entity_instance i left join w using (id) where not is_deleted and " + " and ".join(f"(coalesce(len(list_filter(l, lambda x: starts_with(x, '{p}'))) > 0, false) or coalesce(data ilike '%{p}%', false) or instance_uid ilike '%{p}%')" for p in ("example", "radio")))
def search_instances(spark, folder):
    """Full-text search: all that fit, best first; the order is an approximation."""
    return search.instances(instances(spark, folder), "Example RADIO", most=None).select("id")


@query("select id, name from entity_type where not is_deprecated and project_id = 11 and (name ilike '%patient%' or version ilike '%patient%')")
def search_types(spark, folder):
    return search.types(types(spark, folder), "patient", 11).select("id", "name")


@query("select id, name from entity_type where not is_deprecated and is_base_type")
def current_types(spark, folder):
    return lookup.current_types(types(spark, folder), base=True).select("id", "name")


@query("with r(request, ids) as (values (1, [201, 999, 205]), (2, [101])), e as (select request, unnest(ids) i, generate_subscripts(ids, 1) k from r) select request, array_to_string(list(coalesce(t.name, '-') order by k), ',') as names from e left join entity_type t on t.id = e.i group by 1")
def type_names(spark, folder):
    requests = spark.createDataFrame([(1, [201, 999, 205]), (2, [101])], "request int, ids array<int>")
    found = lookup.positional(requests, types(spark, folder), "ids", "id", "name", "names")
    return found.select("request", F.array_join("names", ",", "-").alias("names"))


@query("with w(wanted) as (values ('regional registry auental'), ('TEST AND training'), ('none')) select wanted, p.id from w left join project p on lower(p.name) = lower(wanted)")
def project_by_name(spark, folder):
    names = spark.createDataFrame([("regional registry auental",), ("TEST AND training",), ("none",)], "wanted string")
    return lookup.one_by_name(projects(spark, folder), names).select("wanted", "id")


@query("select id, name from pseudonym_domain where algorithm = 'MD5' and addcheckdigit order by id limit 1")
def algorithm_by_values(spark, folder):
    return lookup.by_values(table(spark, folder, "pseudonym_domain"), {"algorithm": "MD5", "addcheckdigit": True, "salt": None}).select("id", "name")


@query("select id, instance_uid from entity_instance where entity_type_id = 203 and not is_deleted and id in (select id from entity_instance where project_id = 13)")
def instances_by_ids(spark, folder):
    rows = instances(spark, folder)
    return lookup.instances_by_ids(rows, rows.where("project_id = 13").select("id"), 203).select("id", "instance_uid")


@query("select id request, id from entity_instance where not is_deleted")
def instance_by_any(spark, folder):
    rows = instances(spark, folder)
    return lookup.instance_by_any(rows.select(F.col("id").alias("request"), F.upper("instance_uid").alias("text")), rows)


@query("select 'pseudonym' table_name, count(*) row_count from pseudonym union all select 'entity_instance', count(*) from entity_instance union all select 'audit_event', count(*) from audit_event")
def table_metrics(spark, folder):
    return lookup.table_metrics({n: table(spark, folder, n) for n in ("pseudonym", "entity_instance", "audit_event")})


@query("select i.id, p.name project_name, t.name type_name from entity_instance i left join project p on p.id = i.project_id left join entity_type t on t.id = i.entity_type_id")
def instance_labels(spark, folder):
    return entities.with_labels(instances(spark, folder), projects(spark, folder), types(spark, folder)).select("id", "project_name", "type_name")


@query("select t.id, count(i.id) instances from entity_type t left join entity_instance i on i.entity_type_id = t.id group by 1")
def type_use(spark, folder):
    return entities.type_use(types(spark, folder), instances(spark, folder))


@query("select p.id, (select count(*) from entity_type t where t.project_id = p.id) + (select count(*) from entity_instance i where i.project_id = p.id) uses from project p")
def project_use(spark, folder):
    return entities.project_use(projects(spark, folder), types(spark, folder), instances(spark, folder))


@query("select id, is_deprecated or not exists (select 1 from entity_instance i where i.entity_type_id = t.id) is_deprecated from entity_type t")
def type_deprecate(spark, folder):
    t = types(spark, folder)
    return entities.deprecate_types(t, t.select("id"), entities.type_use(t, instances(spark, folder)))[1].select("id", "is_deprecated")


@query("select id request, case when id % 2 = 0 then 'duplicate' else 'created' end status from entity_type")
def type_create(spark, folder):
    t = types(spark, folder)
    requests = t.select(F.col("id").alias("request"), F.when(F.col("id") % 2 == 0, F.upper("name")).otherwise(F.concat("name", F.lit("X"))).alias("name"), "project_id")
    return entities.create_types(requests, t).select("request", "status")


@query(f"select id, case when id % 2 = 0 then least(coalesce(end_date, timestamptz '{AS_OF}'), timestamptz '{AS_OF}') else end_date end end_date from project")
def project_end(spark, folder):
    p = projects(spark, folder)
    return entities.end_projects(p, p.where("id % 2 = 0"), moment()).select("id", "end_date")


@query("with u as (select p.id, (select count(*) from entity_type t where t.project_id = p.id) + (select count(*) from entity_instance i where i.project_id = p.id) uses from project p) select p.id, 'New ' || p.name as name, case when uses = 0 then 'N' || p.id::varchar else abbreviation end abbreviation, case when (timestamptz '2013-01-01 00:00:00') < start_date then start_date else timestamptz '2013-01-01 00:00:00' end end_date from project p join u using (id)")
def project_update(spark, folder):
    p = projects(spark, folder)
    changes = p.select("id", F.concat(F.lit("New "), "name").alias("name"), F.concat(F.lit("N"), F.col("id").cast("string")).alias("abbreviation"), F.expr("timestamp'2013-01-01'").alias("end_date"))
    return entities.update_projects(changes, p, entities.project_use(p, types(spark, folder), instances(spark, folder))).select("id", "name", "abbreviation", "end_date")


@query(f"select id from project where start_date <= timestamptz '{AS_OF}' and (end_date is null or end_date > timestamptz '{AS_OF}')")
def project_running(spark, folder):
    return entities.running_projects(projects(spark, folder), moment()).select("id")


@query(f"select id, is_deleted or id % 3 = 0 is_deleted, case when id % 3 = 0 and not is_deleted then timestamptz '{AS_OF}' else updated_at end updated_at from entity_instance")
def instance_delete(spark, folder):
    rows = instances(spark, folder)
    return entities.delete_instances(rows.where("id % 3 = 0"), rows, moment()).select("id", "is_deleted", "updated_at")


@query(f"select id, case when id % 5 = 0 and not is_deleted then '{{}}' else data end data, case when id % 5 = 0 and not is_deleted then timestamptz '{AS_OF}' else updated_at end updated_at from entity_instance")
def instance_update(spark, folder):
    rows = instances(spark, folder)
    return entities.update_instances(rows.where("id % 5 = 0").select("id", F.lit("{}").alias("data")), rows, moment())[1].select("id", "data", "updated_at")


@query("select id request, case when id % 2 = 0 then 'duplicate' else 'created' end status from pseudonym_domain")
def domain_create(spark, folder):
    d = table(spark, folder, "pseudonym_domain")
    return entities.create_domains(d.select(F.col("id").alias("request"), F.when(F.col("id") % 2 == 0, F.upper("name")).otherwise(F.concat("name", F.lit("-new"))).alias("name")), d).select("request", "status")


# Permissions; grants are made from the event stream: user, action by type, valid from the event for some hours

_ACTION = {"click": "domain:read", "purchase": "pseudonym:create", "error": "pseudonym:read", "signup": "domain:manage-permissions", "view": "project:read"}
_GRANTS = ("with g as (select user_id::varchar subject_id, case when event_type = 'view' then 'PROJECT' else 'DOMAIN' end resource_type, case when event_type = 'view' then 11 + (event_id % 8)::int else 1 + (event_id % 4)::int end resource_id, "
           "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _ACTION.items()) + " end as action, case when event_id % 11 = 0 then 'DENY' else 'ALLOW' end decision, ts valid_from, ts + to_hours((abs(value)::bigint % 2000)) valid_to from events), "
           "m as (select median(ts) t from events), n as (select distinct subject_id, resource_type, resource_id, action from g where decision = 'ALLOW' and valid_from <= (select t from m) and valid_to > (select t from m))")


def grants(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    kind = F.col("event_type")
    action = F.element_at(F.create_map(*[F.lit(x) for p in _ACTION.items() for x in p]), kind)
    hours = F.rint(F.abs("value")).cast("bigint") % 2000  # halves to even, as in the SQL
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("user_id").cast("string").alias("subject_id"), F.when(kind == "view", "PROJECT").otherwise("DOMAIN").alias("resource_type"), F.when(kind == "view", 11 + F.col("event_id") % 8).otherwise(1 + F.col("event_id") % 4).cast("int").alias("resource_id"), action.alias("action"), F.when(F.col("event_id") % 11 == 0, "DENY").otherwise("ALLOW").alias("decision"), ts.alias("valid_from"), (ts + F.make_dt_interval(F.lit(0), hours.cast("int"))).alias("valid_to"))


def _now(spark: SparkSession, folder: str):
    at = table(spark, folder, "events").agg(F.median(F.unix_micros(F.col("ts").cast("timestamp"))).cast("bigint")).first()[0]
    return F.timestamp_micros(F.lit(at))


@query(_GRANTS + " select * from n")
def effective_permissions(spark, folder):
    return M.allowed_actions(grants(spark, folder), _now(spark, folder))


@query(_GRANTS + " select g.subject_id, g.resource_type, g.resource_id, g.action, exists (select 1 from n where n.subject_id = g.subject_id and n.resource_type = g.resource_type and n.resource_id = g.resource_id and n.action = g.action) allowed from g")
def action_allowed(spark, folder):
    g = grants(spark, folder)
    return M.allowed(g.select(*M.KEY), g, _now(spark, folder))


@query(_GRANTS + ", r as (select event_id request, user_id::varchar requester, 'DOMAIN' resource_type, 1 + (event_id % 4)::int resource_id, case when event_id % 2 = 0 then 'domain:read' else 'project:read' end as action from events) select request, r.action = 'domain:read' and exists (select 1 from n where n.subject_id = requester and n.resource_type = r.resource_type and n.resource_id = r.resource_id and n.action = 'domain:manage-permissions') and exists (select 1 from n where n.subject_id = requester and n.resource_type = r.resource_type and n.resource_id = r.resource_id and n.action = r.action) allowed from r")
def bounded_delegation(spark, folder):
    e = table(spark, folder, "events")
    requests = e.select(F.col("event_id").alias("request"), F.col("user_id").cast("string").alias("requester"), F.lit("DOMAIN").alias("resource_type"), (1 + F.col("event_id") % 4).cast("int").alias("resource_id"), F.when(F.col("event_id") % 2 == 0, "domain:read").otherwise("project:read").alias("action"))
    return M.delegable(requests, grants(spark, folder), M.catalogue(spark), _now(spark, folder)).select("request", "allowed")


@query(_GRANTS + ", w as (select distinct subject_id, resource_type, resource_id, 'domain:update' as action from g where resource_type = 'DOMAIN' union select distinct subject_id, resource_type, resource_id, 'domain:read' from g where resource_type = 'DOMAIN'), c as (select distinct subject_id, resource_type, resource_id, action from g where decision = 'ALLOW' and resource_type = 'DOMAIN') select *, 'insert' op from (select * from w except select * from c) union all select *, 'delete' from (select * from c except select * from w)")
def replace_permissions(spark, folder):
    g = grants(spark, folder)
    scope = g.where("resource_type = 'DOMAIN'").select("subject_id", "resource_type", "resource_id").distinct()
    desired = scope.withColumn("action", F.explode(F.array(F.lit(" domain:update"), F.lit("domain:read"), F.lit(" "))))
    return M.replace(g, desired)


_SOME = _GRANTS + ", held as (select * from g where resource_id % 2 = 0), req as (select row_number() over (order by subject_id, resource_type, resource_id, action) request, * from (select distinct subject_id, resource_type, resource_id, action from g)) "


def _grant_requests(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    from veilframe.operators.pseudonymize import numbered

    g = grants(spark, folder)
    requests = numbered(g.select(*M.KEY).distinct(), M.KEY, 0, "request").withColumn("valid_from", F.lit(None).cast("timestamp")).withColumn("valid_to", F.lit(None).cast("timestamp"))
    return requests, g.where("resource_id % 2 = 0")


@query(_SOME + "select request, case when resource_id % 2 = 0 then 'duplicate' else 'success' end status from req")
def grant_create(spark, folder):
    return M.create(*_grant_requests(spark, folder), moment())[0]


@query(_SOME + f"select subject_id, resource_type, resource_id, action, timestamptz '{AS_OF}' + to_days(3650) valid_to from req where resource_id % 2 = 1")
def grant_create_rows(spark, folder):
    return M.create(*_grant_requests(spark, folder), moment())[1].select(*M.KEY, "valid_to")


@query(_SOME + "select request, resource_id % 2 = 0 deleted from req")
def grant_delete(spark, folder):
    return M.delete(*_grant_requests(spark, folder))[0]


@query("select * from (values " + ", ".join(f"('{t}', '{a}')" for t, some in M.ACTIONS.items() for a in some) + ") v(resource_type, action)")
def permission_catalogue(spark, folder):
    return M.catalogue(spark)


@query(_GRANTS + " select p.id from project p where exists (select 1 from n where n.subject_id = '30' and n.resource_type = 'PROJECT' and n.resource_id = p.id)")
def accessible_projects(spark, folder):
    return M.accessible(projects(spark, folder), grants(spark, folder), "30", _now(spark, folder)).select("id")


@query(_GRANTS + " select g.subject_id, g.resource_type, g.resource_id, g.action, g.valid_from::timestamptz valid_from, coalesce(case when resource_type = 'DOMAIN' then d.name end, case when resource_type = 'PROJECT' then p.abbreviation end) as label from g left join pseudonym_domain d on d.id = g.resource_id and resource_type = 'DOMAIN' left join project p on p.id = g.resource_id and resource_type = 'PROJECT'")
def grant_labels(spark, folder):
    return M.labelled(grants(spark, folder), table(spark, folder, "pseudonym_domain"), projects(spark, folder)).select(*M.KEY, "valid_from", "label")


@query(_GRANTS + ", s as (select distinct subject_id, resource_type, resource_id from g where resource_type = 'PROJECT'), a as (select * from (values " + ", ".join(f"('{a}')" for a in M.ACTIONS["PROJECT"]) + ") v(action)) select subject_id, resource_type, resource_id, action from s cross join a")
def grant_group(spark, folder):
    subjects = grants(spark, folder).where("resource_type = 'PROJECT'").select("subject_id", "resource_type", "resource_id").distinct()
    return M.grant_group(subjects, M.catalogue(spark))


@query(_GRANTS + " select subject_id, resource_type, resource_id, action, valid_from::timestamptz valid_from from g where not (resource_type = 'DOMAIN' and resource_id = 2)")
def grant_revoke(spark, folder):
    gone = spark.createDataFrame([("DOMAIN", 2)], "resource_type string, resource_id int")
    return M.revoke(grants(spark, folder), gone).select(*M.KEY, "valid_from")


@query("with r(resource_type, label) as (values ('DOMAIN', ' nordlicht '), ('PROJECT', 'bbn'), ('GLOBAL', null), ('PROJECT', 'nothing')) select r.*, case when resource_type = 'GLOBAL' then 0 else coalesce((select id from pseudonym_domain d where r.resource_type = 'DOMAIN' and lower(d.name) = lower(trim(label))), (select id from project p where r.resource_type = 'PROJECT' and lower(p.abbreviation) = lower(trim(label)))) end resource_id from r")
def resource_ids(spark, folder):
    requests = spark.createDataFrame([("DOMAIN", " nordlicht "), ("PROJECT", "bbn"), ("GLOBAL", None), ("PROJECT", "nothing")], "resource_type string, label string")
    return M.resource_ids(requests, table(spark, folder, "pseudonym_domain"), projects(spark, folder))


@query("select event_id, case when event_id % 7 = 0 then 'no subject' when event_id % 5 = 0 then 'no such resource type' when event_id % 3 = 0 then 'no such action' end reason from events")
def grant_check(spark, folder):
    e = F.col("event_id")
    rows = table(spark, folder, "events").select("event_id", F.when(e % 7 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("subject_id"), F.when(e % 5 == 0, "WORLD").otherwise("DOMAIN").alias("resource_type"), F.lit(1).alias("resource_id"), F.when(e % 3 == 0, "project:read").otherwise("domain:read").alias("action"))
    return M.checked(rows, M.catalogue(spark)).select("event_id", "reason")


@query("select event_id, case event_id % 4 when 0 then event_type <> 'x' when 1 then false when 2 then event_type <> 'x' else event_type <> 'x' end fits from events")
def permission_target(spark, folder):
    k = F.col("event_id") % 4
    kind = F.when(k == 0, "domain").when(k == 1, "PROJECT").when(k == 2, "Global").otherwise("PROJECT")
    name = F.when(k.isin(0, 1), F.col("event_type"))
    abbreviation = F.when(k.isin(1, 3), F.col("event_type"))
    return table(spark, folder, "events").select("event_id", present.permission_target(kind, name, abbreviation).alias("fits"))


# The audit trail


@query("select id from audit_event where request_time is null or request_time >= timestamp '2025-10-20' - to_days(10)")
def audit_retention(spark, folder):
    return audit.retained(table(spark, folder, "audit_event"), F.expr("timestamp_ntz'2025-10-20 00:00:00'"), 10).select("id")


_GROUPS = "list_filter([case when id % 2 = 0 then '/technical-users' end, case when id % 3 = 0 then '/human-users' end, case when id % 5 = 0 then '/no-auditing' end, case when id % 7 = 0 then '/audit-everything' end, '/staff'], lambda x: x is not null)"


@query(f"with g as (select id, {_GROUPS} g from audit_event) select id, case when list_contains(g, '/human-users') then 'HUMAN' when list_contains(g, '/technical-users') then 'TECHNICAL' when list_contains(g, '/audit-everything') then 'ALL' when list_contains(g, '/no-auditing') then 'NONE' else 'UNKNOWN' end kind from g")
def audit_user_type(spark, folder):
    i = F.col("id")
    groups = F.array_compact(F.array(F.when(i % 2 == 0, "/technical-users"), F.when(i % 3 == 0, "/human-users"), F.when(i % 5 == 0, "/no-auditing"), F.when(i % 7 == 0, "/audit-everything"), F.lit("/staff")))
    return table(spark, folder, "audit_event").select("id", audit.user_type(groups).alias("kind"))


@query("""select request_time, coalesce(case when trim(user_name) <> '' then user_name end, case when topic is not null then 'KAFKA' else 'UNKNOWN' end) user_name,
 case when topic is null then coalesce(case when id % 2 = 0 and trim(requester_ip) <> '' then requester_ip end, '127.0.0.1') end requester_ip, case when topic is null then request_url || '?q=1' end request_url,
 regexp_replace(case when strlen(request_body) > 4096 then substr(request_body, 1, 4096) || '...' else request_body end, '[\\t\\n\\x0b\\f\\r ]+', '', 'g') request_body, case when topic is null then 'REST' else 'KAFKA' end source_system, topic, case when topic is not null then "partition" end as "partition", case when topic is not null then record_offset end record_offset
 from audit_event""")
def audit_build(spark, folder):
    rows = table(spark, folder, "audit_event").select("request_time", "user_name", F.when(F.col("id") % 2 == 0, F.concat("requester_ip", F.lit(", 10.9.9.9"))).alias("forwarded"), F.lit(" ").alias("real_ip"), F.lit("127.0.0.1").alias("remote"), F.col("request_url").alias("url"), F.lit("q=1").alias("query"), F.col("request_body").alias("body"), "topic", "partition", "record_offset")
    return audit.build(rows)


@query("select id, coalesce(case when id % 3 = 0 and trim(requester_ip) <> '' then requester_ip end, case when trim(user_name) <> '' then user_name end, 'UNKNOWN') who from audit_event")
def audit_requester(spark, folder):
    return table(spark, folder, "audit_event").select("id", audit.requester(F.when(F.col("id") % 3 == 0, F.col("requester_ip")), F.col("user_name")).alias("who"))


@query("select id, case when length(request_body) > 40 then substr(request_body, 1, 40) || '...' else request_body end body from audit_event")
def audit_truncated(spark, folder):
    return table(spark, folder, "audit_event").select("id", audit.truncated(F.col("request_body"), 40).alias("body"))


@query(_SOME + "select subject_id, resource_type, resource_id, action, valid_from::timestamptz valid_from, case when resource_id % 3 = 0 then 'DENY' else decision end decision, greatest(valid_from, valid_to)::timestamptz valid_to from held")
def grant_update(spark, folder):
    """Grants after every third resource's were denied."""
    requests, held = _grant_requests(spark, folder)
    changes = requests.where("resource_id % 3 = 0").withColumn("decision", F.lit("DENY"))
    return M.update(changes, held)[1].select(*M.KEY, "valid_from", "decision", "valid_to")


@query(_SOME + "select request, resource_id % 2 = 0 updated from req where resource_id % 3 = 0")
def grant_update_flags(spark, folder):
    requests, held = _grant_requests(spark, folder)
    return M.update(requests.where("resource_id % 3 = 0").withColumn("decision", F.lit("DENY")), held)[0]


_LEAVES = "with recursive n(id, path, a) as (select id, '', unnest(json_extract(type_definition::json, '$.attributes[*]')) from entity_type where json_valid(type_definition) union all select id, case when json_extract_string(a, '$.layout') = 'group' and json_extract_string(a, '$.name') is not null then concat_ws('.', nullif(path, ''), json_extract_string(a, '$.name')) else path end, unnest(json_extract(a, '$.attributes[*]')) from n where json_type(a, '$.attributes') = 'ARRAY'), leaf as (select id, concat_ws('.', nullif(path, ''), json_extract_string(a, '$.name')) path, json_extract_string(a, '$.type') as kind, coalesce(json_extract_string(a, '$.required') = 'true', false) required from n where json_type(a, '$.attributes') is null)"


@query(_LEAVES + " select id, path, kind, required from leaf")
def type_leaves(spark, folder):
    """The leaf attributes of every type definition (configuration) with their paths."""
    import json

    rows = types(spark, folder).select("id", "type_definition").collect()
    found = [(r.id, path, node.get("type"), bool(node.get("required"))) for r in rows for path, node in schema.leaves(json.loads(r.type_definition)).items()]
    return spark.createDataFrame(found, "id int, path string, kind string, required boolean")


@query(_LEAVES + " select b.id base, p.id project, count(*) filter (not exists (select 1 from leaf x where x.id = p.id and x.path = b.path)) missing from leaf b, entity_type p group by 1, 2")
def type_specialises(spark, folder):
    """How many attributes of each type every other one lacks, as a specialisation of it may not (configuration)."""
    import json

    rows = {r.id: json.loads(r.type_definition) for r in types(spark, folder).select("id", "type_definition").collect()}
    found = [(b, p, sum(e.endswith("is missing") for e in schema.specialisation_errors(rows[b], rows[p]))) for b in rows for p in rows]
    return spark.createDataFrame(found, "base int, project int, missing long")


@query(_LEAVES + " select id, 0::bigint errors, count(*) broken from leaf group by 1")
def type_definition_errors(spark, folder):
    """Errors in each type's definition as it is, and after every attribute was given a type that doesn't exist."""
    import json

    def spoilt(nodes):
        return [{**n, "attributes": spoilt(n["attributes"])} if "attributes" in n else {**n, "type": "nonsense"} for n in nodes]

    rows = [(r.id, json.loads(r.type_definition)) for r in types(spark, folder).select("id", "type_definition").collect()]
    found = [(i, len(schema.definition_errors(d)), len(schema.definition_errors({"attributes": spoilt(d["attributes"])}))) for i, d in rows]
    return spark.createDataFrame(found, "id int, errors long, broken long")


@query("select doc_id, case when text is null or text = '' then 'empty' when strlen(text) > 5242880 then 'too large' when doc_kind not in ('ticket', 'mail') or doc_kind is null then 'wrong type' end reason from documents")
def image_checks(spark, folder):
    """Texts as if they were images, typed by their kind."""
    mime = F.when(F.col("doc_kind") == "ticket", "image/PNG").when(F.col("doc_kind") == "mail", "image/webp").otherwise("text/plain")
    return entities.usable_images(documents(spark, folder).select("doc_id", F.encode("text", "utf-8").alias("data"), mime.alias("mime"))).select("doc_id", "reason")


# The stream, as one batch: messages are the bodies of stream events

_MESSAGES = "with m as (select id, request_body b, case when json_valid(request_body) then request_body end j from audit_event where source_system = 'KAFKA'), f as (select id, json_extract_string(j, '$.identifier') identifier, json_extract_string(j, '$.idType') idtype, json_extract_string(j, '$.sourceDomain') as domain, j from m)"


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "audit_event").where("source_system = 'KAFKA'").select("id", F.col("request_body").alias("value"))


@query(_MESSAGES + " select id, identifier, idtype, domain, case when j is null then 'malformed' when coalesce(trim(identifier), '') = '' then 'no identifier' when coalesce(trim(idtype), '') = '' then 'no type' when coalesce(trim(domain), '') = '' then 'no domain' end reject from f")
def stream_parse(spark, folder):
    return ingest.parsed(_messages(spark, folder)).select("id", "identifier", "idtype", "domain", "reject")


@query(_MESSAGES + " select min(trim(domain)) as name, upper(substr(min(trim(domain)), 1, 2)) || '-' prefix, 'RANDOM_LET' algorithm, 16 pseudonymlength, true addcheckdigit, false multiplepsnallowed, 32 signs, to_days(0) + least(min(case when try_cast(json_extract_string(j, '$.validFrom') as timestamp) <= timestamp '2024-06-01' then try_cast(json_extract_string(j, '$.validFrom') as timestamp) end), timestamp '2024-06-01') validfrom from f where j is not null and trim(domain) <> '' and trim(identifier) <> '' and trim(idtype) <> '' and lower(trim(domain)) not in (select lower(name) from pseudonym_domain where id % 2 = 0) group by lower(trim(domain))")
def stream_new_domains(spark, folder):
    known = table(spark, folder, "pseudonym_domain").where("id % 2 = 0")
    fresh = ingest.new_domains(ingest.parsed(_messages(spark, folder)), known, F.expr("timestamp_ntz'2024-06-01 00:00:00'"))
    return fresh.select("name", "prefix", "algorithm", "pseudonymlength", "addcheckdigit", "multiplepsnallowed", F.length("salt").alias("signs"), "validfrom")


#: Rows of the stream in domains known beforehand, with what each must end as; the first half of the pseudonyms is held.
_STREAM = _MESSAGES + """, held as (select * from pseudonym where id % 2 = 0),
r as (select distinct identifier, idtype, d.id domainid from f join pseudonym_domain d on lower(d.name) = lower(trim(f.domain)) where j is not null and trim(identifier) <> '' and trim(idtype) <> ''),
q as (select r.*, d.*, exists (select 1 from held h where h.domainid = r.domainid and h.identifier = r.identifier and h.idtype = r.idtype) same_id from r join (select id, algorithm, prefix, salt, addcheckdigit c, lengthincludescheckdigit i, pseudonymlength l, paddingcharacter p, multiplepsnallowed m, validto from pseudonym_domain) d on d.id = r.domainid),
h as (select *, lpad(case algorithm when 'MD5' then upper(md5(identifier || idtype || salt)) when 'SHA1' then upper(sha1(identifier || idtype || salt)) end, l, p) h from q)
"""


def _streamed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    held = table(spark, folder, "pseudonym").where("id % 2 = 0").select("domainid", "identifier", "idtype", "pseudonym")
    return ingest.batch(_messages(spark, folder).select("value"), table(spark, folder, "pseudonym_domain"), held, F.expr("timestamp_ntz'2025-06-01 00:00:00'"))


@query(_STREAM + "select identifier, idtype, domainid, case when validto < timestamp '2025-06-01' then 'domain expired' when same_id and not m then 'duplicate identifier' else 'success' end status, case when not m and h is not null and validto >= timestamp '2025-06-01' then prefix || h end body, validto >= timestamp '2025-06-01' made from h")
def stream_rows(spark, folder):
    """Every request of the stream's messages with its domain, status and pseudonym: the text before its check digit
    where SQL knows the hash, and whether there is one at all."""
    results, _, domains = _streamed(spark, folder)
    d = domains.select(F.col("id").alias("domainid"), "prefix", "algorithm", "pseudonymlength", "multiplepsnallowed")
    known = F.col("algorithm").isin("MD5", "SHA1") & ~F.col("multiplepsnallowed")
    body = F.when(known, F.substring(F.col("pseudonym"), F.lit(1), F.length("prefix") + F.col("pseudonymlength")))
    return results.join(d, "domainid").select("identifier", "idtype", "domainid", "status", body.alias("body"), F.col("pseudonym").isNotNull().alias("made"))


@query(_STREAM + ", n as (select domainid, count(*) n from h where validto >= timestamp '2025-06-01' group by 1) select d.id, consecutivevaluecounter + case when algorithm = 'CONSECUTIVE' or (multiplepsnallowed and algorithm not like 'RANDOM%') then coalesce(n, 0) else 0 end counter from pseudonym_domain d left join n on n.domainid = d.id")
def stream_counters(spark, folder):
    """Counters of the domains after the batch."""
    return _streamed(spark, folder)[2].select("id", F.col("consecutivevaluecounter").alias("counter"))


@query(_STREAM + ", s as (select case when validto < timestamp '2025-06-01' then 'domain expired' when same_id and not m then 'duplicate identifier' else 'success' end status from h), x as (select case when j is null then 'malformed' when coalesce(trim(identifier), '') = '' then 'no identifier' when coalesce(trim(idtype), '') = '' then 'no type' when coalesce(trim(domain), '') = '' then 'no domain' end status from f) select status, count(*) n from (select status from s union all select status from x where status is not null) group by 1")
def stream_batch(spark, folder):
    """How a whole batch ends: parsed, validated, pseudonymised and classified; streaming and batch are compared in the
    tests."""
    results, rejects, _ = _streamed(spark, folder)
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n")).unionByName(rejects.groupBy(F.col("reject").alias("status")).agg(F.count(F.lit(1)).alias("n")))


@query()
def json_path_values(spark, folder):
    """All diagnosis codes of the encounters, through both arrays; tested by itself."""
    from veilframe.functions.jsonpath import values

    return instances(spark, folder).where("entity_type_id = 201").select("id", values("encounters.diagnoses.code")("data").alias("codes"))


@query(_CUST + f", t as ({_tokens_sql(PLAIN)}) select * from t where id % 9 = 0")
def tokens_of(spark, folder):
    made = L.tokens(customers(spark, folder), PLAIN, COLUMNS).drop("bits")
    return L.tokens_of(made, customers(spark, folder).where("id % 9 = 0"))
