"""Queries on pseudonyms and domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.functions import luhn, validity
from veilframe.operators import classify, linked, lookup, present, pseudonymize as P, search, tree
from veilframe.queries.registry import Registry
from veilframe.sources.tables import table

query = Registry()
queries, oracle_sql = query.queries, query.oracle_sql

AS_OF = "2024-06-01 00:00:00"


def moment():
    return F.expr(f"timestamp_ntz'{AS_OF}'")


SALT = "north-sea-grain-17"


def digit_sql(text: str, alphabet: str, first: int = 2) -> str:
    """The Luhn sum of ``text`` in SQL, null at a sign outside the alphabet."""
    n = len(alphabet)
    index = f"(strpos('{alphabet}', substr({text}, length({text}) - i + 1, 1)) - 1)"
    factor = f"(case when i % 2 = 1 then {first} else {3 - first} end)"
    bad = f"len(list_filter(range(1, length({text}) + 1), lambda i: strpos('{alphabet}', substr({text}, i, 1)) = 0)) > 0"
    return f"(case when {bad} then null else coalesce(list_sum(list_transform(range(1, length({text}) + 1), lambda i: ({factor} * {index}) // {n} + ({factor} * {index}) % {n})), 0) end)"


def check_sql(text: str, alphabet: str) -> str:
    n = len(alphabet)
    return f"substr('{alphabet}', (({n} - {digit_sql(text, alphabet)} % {n}) % {n} + 1)::int, 1)"


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey"), F.col("c_custkey").cast("string").alias("identifier"), F.lit("CUST").alias("idtype"))


def domains(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pseudonym_domain")


def pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pseudonym")


# Making pseudonyms

_MD5 = f"upper(md5(c_custkey::varchar || 'CUST' || '{SALT}'))"


@query(f"with h as (select c_custkey, {_MD5} h from customer) select c_custkey, 'CU-' || h || {check_sql('h', luhn.MOD16)} psn from h")
def psn_md5_luhn(spark, folder):
    scheme = P.Scheme("MD5", prefix="CU-", salt=SALT, check_digit=True)
    return P.pseudonymize(customers(spark, folder), scheme).select("c_custkey", "psn")


@query(f"with h as (select c_custkey, substr({_MD5}, 1, 15) h from customer) select c_custkey, h || {check_sql('h', luhn.MOD16)} psn from h")
def psn_digit_included(spark, folder):
    scheme = P.Scheme("MD5", length=16, salt=SALT, check_digit=True, digit_included=True)
    return P.pseudonymize(customers(spark, folder), scheme).select("c_custkey", "psn")


@query(f"select c_custkey, lpad(upper(sha1(c_custkey::varchar || 'CUST' || '{SALT}')), 44, '_') psn from customer")
def psn_sha1(spark, folder):
    return P.pseudonymize(customers(spark, folder), P.Scheme("SHA1", length=44, padding="_", salt=SALT)).select("c_custkey", "psn")


@query(f"select c_custkey, substr(upper(md5(c_custkey::varchar || 'CUST' || '{SALT}' || (row_number() over (order by c_custkey) + 6)::varchar)), 1, 20) psn from customer")
def psn_multi_counter(spark, folder):
    scheme = P.Scheme("MD5", length=20, salt=SALT, multiple=True, counter=7)
    return P.pseudonymize(customers(spark, folder), scheme, order="c_custkey").select("c_custkey", "psn")


def _hash(algorithm: str, length: int):
    def run(spark, folder):
        return P.pseudonymize(customers(spark, folder), P.Scheme(algorithm, length=length, salt=SALT, check_digit=True)).select("c_custkey", "psn")

    run.__name__ = f"psn_{algorithm.lower()}"
    run.__doc__ = f"{algorithm} pseudonyms of all customers; golden values are in the tests."
    return query()(run)


for _name, _length in (("SHA2", 128), ("SHA3", 128), ("BLAKE3", 64), ("XXHASH", 16)):
    _hash(_name, _length)


@query(f"with c as (select s_suppkey, lpad((row_number() over (order by s_suppkey) + 41)::varchar, 8, '0') h from supplier) select s_suppkey, 'S-' || h || {check_sql('h', luhn.MOD10)} psn from c")
def psn_consecutive(spark, folder):
    rows = table(spark, folder, "supplier").select("s_suppkey", F.col("s_name").alias("identifier"), F.lit("S").alias("idtype"))
    scheme = P.Scheme("CONSECUTIVE", prefix="S-", length=8, check_digit=True, counter=41)
    return P.pseudonymize(rows, scheme, order="s_suppkey").select("s_suppkey", "psn")


def _random(algorithm: str):
    def run(spark, folder):
        return P.pseudonymize(customers(spark, folder), P.Scheme(algorithm, length=16, check_digit=True)).select("c_custkey", "psn")

    run.__name__ = f"psn_{algorithm.lower()}"
    run.__doc__ = f"{algorithm} pseudonyms; alphabet, length and check digit are tested."
    return query()(run)


for _name in ("RANDOM_NUM", "RANDOM_HEX", "RANDOM_LET", "RANDOM_SYM", "RANDOM_SYM_BIOS", "RANDOM"):
    _random(_name)


@query()
def psn_retry(spark, folder):
    """Random creation in a small space, with three attempts; collisions that remain say so."""
    rows = customers(spark, folder).select(F.col("c_custkey").alias("request"), F.lit(1).alias("domainid"), "identifier", "idtype")
    held = rows.limit(0).withColumn("pseudonym", F.lit(""))
    draw = lambda some, k: P.pseudonymize(some, P.Scheme("RANDOM_LET", length=5), name="pseudonym", seed=17 + k)
    return classify.create_with_retries(rows, held, draw).select("request", "status")


_DOMAIN_HASH = "case upper(trim(d.algorithm)) when 'MD5' then upper(md5(t)) when 'SHA1' then upper(sha1(t)) when 'CONSECUTIVE' then n::varchar end"
#: What is known in SQL of every row's pseudonym: the text in domains of MD5, SHA1 and numbers, the number of signs in all.
_BY_DOMAIN = f"""with c as (select p.id, p.domainid, coalesce(d.consecutivevaluecounter, 0) + row_number() over (partition by p.domainid order by p.id) n, p.identifier || p.idtype || coalesce(d.salt, '') k from pseudonym p join pseudonym_domain d on d.id = p.domainid where p.identifier is not null and p.idtype is not null),
k as (select c.*, d.*, case when d.multiplepsnallowed then k || (n - 1)::varchar else k end t from c join pseudonym_domain d on d.id = c.domainid),
h as (select k.id, d.prefix, d.algorithm, d.addcheckdigit c, d.lengthincludescheckdigit and d.algorithm <> 'CONSECUTIVE' i, d.pseudonymlength l, lpad({_DOMAIN_HASH}, d.pseudonymlength, d.paddingcharacter) h from k join pseudonym_domain d on d.id = k.domainid),
b as (select *, case when c and i then substr(h, 1, length(h) - 1) else h end b from h)
"""


@query(_BY_DOMAIN.replace("select c.*, d.*,", "select c.*,") + f"select id, case when h is not null then prefix || case when c then b || case algorithm when 'CONSECUTIVE' then {check_sql('b', luhn.MOD10)} else {check_sql('b', luhn.MOD16)} end else h end end psn, length(prefix) + l + case when c and not i then 1 else 0 end signs from b")
def psn_by_domain(spark, folder):
    """Pseudonyms of all rows by their domain's own algorithm; text where SQL knows the hash, the length everywhere. The
    texts of the other algorithms are tested row by row."""
    made = P.by_domain(pseudonyms(spark, folder).where("identifier is not null and idtype is not null"), domains(spark, folder), order="id")
    kinds = domains(spark, folder).select(F.col("id").alias("domainid"), F.upper(F.trim("algorithm")).isin("MD5", "SHA1", "CONSECUTIVE").alias("known"))
    return made.join(kinds, "domainid").select("id", F.when(F.col("known"), F.col("psn")).alias("psn"), F.length("psn").alias("signs"))


@query("with u as (select domainid, count(*) n from pseudonym where identifier is not null and idtype is not null group by 1) select d.id, coalesce(consecutivevaluecounter, 0) + case when algorithm = 'CONSECUTIVE' or (multiplepsnallowed and algorithm in ('MD5', 'SHA1', 'SHA2', 'SHA3', 'BLAKE3', 'XXHASH')) then coalesce(n, 0) else 0 end counter from pseudonym_domain d left join u on u.domainid = d.id")
def psn_counters(spark, folder):
    """Counters of the domains after a pseudonym was made for every row."""
    made = pseudonyms(spark, folder).where("identifier is not null and idtype is not null")
    return P.advanced(domains(spark, folder), made).select("id", F.coalesce("consecutivevaluecounter", F.lit(0)).alias("counter"))


_BODY = "upper(trim(substr(p.pseudonym, length(d.prefix) + 1)))"


@query(f"select p.id, case when not starts_with(p.pseudonym, d.prefix) then false else {digit_sql(_BODY, luhn.MOD16, 1)} % 16 = 0 end valid from pseudonym p join pseudonym_domain d on d.id = p.domainid")
def luhn_validate(spark, folder):
    rows = pseudonyms(spark, folder).join(domains(spark, folder).select(F.col("id").alias("domainid"), "prefix"), "domainid")
    return rows.select("id", luhn.valid(F.col("pseudonym"), F.col("prefix"), luhn.MOD16).alias("valid"))


@query(f"select c_custkey, {check_sql('c_custkey::varchar', luhn.MOD10)} d10, {check_sql('upper(c_mktsegment)', luhn.MOD26)} d26, {check_sql('upper(md5(c_name))', luhn.MOD32)} d32, {check_sql('upper(md5(c_name))', luhn.MOD36)} d36 from customer")
def luhn_alphabets(spark, folder):
    none = F.lit("")
    hashed = F.upper(F.md5("c_name"))
    return table(spark, folder, "customer").select("c_custkey", luhn.compute(F.col("c_custkey").cast("string"), none, luhn.MOD10).alias("d10"), luhn.compute(F.col("c_mktsegment"), none, luhn.MOD26).alias("d26"), luhn.compute(hashed, none, luhn.MOD32).alias("d32"), luhn.compute(hashed, none, luhn.MOD36).alias("d36"))


@query("select p_partkey, lpad(p_name, 12, '*') padded, substr(p_name, 1, 12) cut from part")
def length_correction(spark, folder):
    c = F.col("p_name")
    return table(spark, folder, "part").select("p_partkey", luhn.corrected_length(c, F.lit(12), F.lit("*")).alias("padded"), luhn.corrected_length(c, F.lit(12), F.lit("*"), pad=False).alias("cut"))


@query("select id, ceil(ln(ceil(randomalgorithmdesiredsize / pow(1 - randomalgorithmdesiredsuccessprobability, 1/3.0::double))) / ln(length(alphabet)))::int signs from pseudonym_domain")
def psn_length_plan(spark, folder):
    return domains(spark, folder).select("id", luhn.pseudonym_length_column(F.col("randomalgorithmdesiredsize"), F.col("randomalgorithmdesiredsuccessprobability"), F.length("alphabet")).alias("signs"))


@query("with n as (select domainid, count(*) n from pseudonym group by 1) select d.id domainid, coalesce(n, 0) amount, coalesce(n, 0) > pow(10.0, pseudonymlength) * pow(1 - randomalgorithmdesiredsuccessprobability, 1/3.0::double) too_full from pseudonym_domain d left join n on n.domainid = d.id")
def fill_rate(spark, folder):
    return P.fill_rate(domains(spark, folder), pseudonyms(spark, folder))


@query("select p.id, case when starts_with(trim(p.pseudonym), 'NO-') then trim(p.pseudonym) else 'NO-' || trim(p.pseudonym) end psn from pseudonym p")
def supplied_psn(spark, folder):
    return pseudonyms(spark, folder).select("id", P.supplied(F.col("pseudonym"), F.lit("NO-")).alias("psn"))


@query("select id, case when algorithm in ('CONSECUTIVE', 'RANDOM_NUM') then '0123456789' when algorithm = 'RANDOM_LET' then 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' else 'ABCDEF0123456789' end signs, case when algorithm in ('CONSECUTIVE', 'RANDOM_NUM') then '0123456789' when algorithm = 'RANDOM_LET' then 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' else '0123456789ABCDEF' end digits, length(salt) between 8 and 256 and trim(salt) <> '' salted from pseudonym_domain")
def domain_alphabets(spark, folder):
    """The alphabets of each domain's pseudonyms and check digits, and whether its salt will do."""
    made = P.settings(domains(spark, folder)).select(F.col("domainid").alias("id"), F.col("_signs").alias("signs"), F.col("_digits").alias("digits"), (F.length("_s").between(8, 256) & (F.trim("_s") != "")).alias("salted"))
    return made


@query(f"select p.id, case when not starts_with(p.pseudonym, d.prefix) then false when d.algorithm in ('CONSECUTIVE', 'RANDOM_NUM', 'RANDOM') then {digit_sql(_BODY, luhn.MOD10, 1)} % 10 = 0 when d.algorithm = 'RANDOM_LET' then {digit_sql(_BODY, luhn.MOD26, 1)} % 26 = 0 else {digit_sql(_BODY, luhn.MOD16, 1)} % 16 = 0 end valid from pseudonym p join pseudonym_domain d on d.id = p.domainid")
def validate_by_domain(spark, folder):
    """Check digits by the validation's own choice of alphabet for each domain's algorithm."""
    tables = {a: luhn.check_alphabet(a, legacy=True) for a in ("MD5", "SHA1", "SHA2", "SHA3", "BLAKE3", "XXHASH", "CONSECUTIVE", "RANDOM", "RANDOM_NUM", "RANDOM_LET", "RANDOM_SYM", "RANDOM_SYM_BIOS")}
    alphabet = F.element_at(F.create_map(*[F.lit(x) for pair in tables.items() for x in pair]), F.upper(F.trim("algorithm")))
    d = domains(spark, folder).select(F.col("id").alias("domainid"), "prefix", alphabet.alias("signs"))
    rows = pseudonyms(spark, folder).join(d, "domainid")
    text = luhn.standardized(F.col("pseudonym"), F.col("prefix"))
    valid = F.when(F.col("pseudonym").isNotNull() & text.isNull(), F.lit(False)).otherwise(luhn.digit_sum(text, F.col("signs"), 1) % F.length("signs") == 0)
    return rows.select("id", valid.alias("valid"))


# Validity

_UNITS = "['d', ' w', 'hours', ' minutes', 'secs', ' mo.', 'yrs', ' ms', ' fortnight', '']"


@query(f"""with t as (select o_orderkey, o_orderdate, (o_orderkey % 50) n, (o_orderkey % 10)::int u from orders)
select o_orderkey, case u when 0 then o_orderdate + to_days(n::int) when 1 then o_orderdate + to_days(7 * n::int) when 2 then o_orderdate + to_hours(n) when 3 then o_orderdate + to_minutes(n) when 4 then o_orderdate + to_seconds(n)
 when 5 then o_orderdate + to_months(n::int) when 6 then o_orderdate + to_years(n::int) when 7 then o_orderdate + to_milliseconds(n) end ends from t""")
def validity_time_parse(spark, folder):
    units = F.array(*map(F.lit, ["d", " w", "hours", " minutes", "secs", " mo.", "yrs", " ms", " fortnight", ""]))
    text = F.concat((F.col("o_orderkey") % 50).cast("string"), F.element_at(units, (F.col("o_orderkey") % 10 + 1).cast("int")))
    return table(spark, folder, "orders").select("o_orderkey", validity.plus(F.col("o_orderdate"), text).alias("ends"))


@query("""with j as (select p.id, p.validfrom gf, case when p.id % 3 = 0 then null else p.validto end gt, d.validfrom df, d.validto dt, d.enforcestartdatevalidity es, d.enforceenddatevalidity ee from pseudonym p join pseudonym_domain d on d.id = p.domainid),
s as (select *, case when gf is null then df when es then greatest(gf, df) else gf end f from j),
e as (select *, coalesce(gt, case when id % 2 = 0 then f + to_days(84) end) w from s)
select id, f "start", (gf is null or (es and not (gf > df))) start_inherited, case when w is null then dt when ee then least(w, dt) else w end "end", (w is null or (ee and not (w < dt))) end_inherited from e""")
def validity_clamp(spark, folder):
    d = domains(spark, folder).select(F.col("id").alias("domainid"), F.col("validfrom").alias("df"), F.col("validto").alias("dt"), F.col("enforcestartdatevalidity").alias("es"), F.col("enforceenddatevalidity").alias("ee"))
    rows = pseudonyms(spark, folder).join(d, "domainid")
    start, start_inherited = validity.clamp_start(F.col("validfrom"), F.col("df"), F.col("es"))
    rows = rows.withColumn("start", start).withColumn("start_inherited", start_inherited)
    given, period = F.when(F.col("id") % 3 != 0, F.col("validto")), F.when(F.col("id") % 2 == 0, F.lit("12 weeks"))
    rows = rows.withColumn("wanted", validity.wanted_end(given, period, F.col("start")))
    end, end_inherited = validity.clamp_end(F.col("wanted"), F.col("dt"), F.col("ee"))
    return rows.select("id", "start", "start_inherited", end.alias("end"), end_inherited.alias("end_inherited"))


@query("select id, case id % 3 when 0 then date_trunc('day', request_time) when 1 then date_trunc('minute', request_time) else date_trunc('second', request_time) - to_hours(2) end moment from audit_event")
def datetime_parse(spark, folder):
    t = F.col("request_time")
    text = F.when(F.col("id") % 3 == 0, F.date_format(t, "yyyy-MM-dd")).when(F.col("id") % 3 == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm")).otherwise(F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")))
    return table(spark, folder, "audit_event").select("id", validity.parse(text).cast("timestamp_ntz").alias("moment"))


@query(f"select id from pseudonym where (validfrom is null or validfrom <= timestamp '{AS_OF}') and (validto is null or validto > timestamp '{AS_OF}')")
def valid_now(spark, folder):
    return pseudonyms(spark, folder).where(validity.valid_at(F.col("validfrom"), F.col("validto"), moment())).select("id")


@query(f"select d.id, d.validto < timestamp '{AS_OF}' expired from pseudonym_domain d")
def domains_expired(spark, folder):
    return domains(spark, folder).select("id", (F.col("validto") < moment()).alias("expired"))


# Lookups and search


@query("with w(wanted) as (values ('nordlicht'), (' NORDLICHT-Labor '), ('nowhere')) select wanted, d.id, d.name from w left join pseudonym_domain d on lower(d.name) = lower(trim(wanted))")
def domain_by_name(spark, folder):
    names = spark.createDataFrame([("nordlicht",), (" NORDLICHT-Labor ",), ("nowhere",)], "wanted string")
    return lookup.one_by_name(domains(spark, folder), names).select("wanted", "id", "name")


@query("select id, name, prefix, algorithm, superdomainid from pseudonym_domain")
def domain_list(spark, folder):
    return domains(spark, folder).select("id", "name", "prefix", "algorithm", "superdomainid")


@query("select id, identifier, idtype, pseudonym from pseudonym where domainid = 1")
def domain_pseudonyms(spark, folder):
    return lookup.in_domain(pseudonyms(spark, folder), 1).select("id", "identifier", "idtype", "pseudonym")


@query("select pseudonym from pseudonym where domainid = 2")
def domain_values(spark, folder):
    return lookup.export(pseudonyms(spark, folder), 2, most=50_000_000).select("pseudonym")


@query("select p.id request, q.id from pseudonym p join pseudonym q using (identifier, idtype, domainid)")
def lookup_forward(spark, folder):
    rows = pseudonyms(spark, folder)
    return lookup.by_identifier(rows.select(F.col("id").alias("request"), "identifier", "idtype", "domainid"), rows).select("request", "id")


@query("with s as (select domainid, pseudonym, any_value(id) id, any_value(identifier) identifier, any_value(idtype) idtype from pseudonym group by 1, 2 having count(*) = 1) select p.id request, s.domainid, s.pseudonym psn, s.id, s.identifier, s.idtype from pseudonym p join s using (domainid, pseudonym)")
def lookup_reverse(spark, folder):
    rows = pseudonyms(spark, folder)
    return lookup.by_pseudonym(rows.select(F.col("id").alias("request"), "domainid", F.col("pseudonym").alias("psn")), rows)


@query("""with r as (select id request, domainid, case when id % 4 < 2 then identifier end i, case when id % 4 < 2 then idtype end t, case when id % 4 in (1, 2) then pseudonym end p from pseudonym)
select request, q.id from r join pseudonym q on q.domainid = r.domainid and ((r.i is not null and q.identifier = r.i and q.idtype = r.t and (r.p is null or q.pseudonym = r.p)) or (r.i is null and q.pseudonym = r.p))""")
def lookup_dispatch(spark, folder):
    rows = pseudonyms(spark, folder)
    k = F.col("id") % 4
    requests = rows.select(F.col("id").alias("request"), "domainid", F.when(k < 2, F.col("identifier")).alias("identifier"), F.when(k < 2, F.col("idtype")).alias("idtype"), F.when(k.isin(1, 2), F.col("pseudonym")).alias("psn"))
    return lookup.dispatch(requests, rows)


_VALID = f"domainid = 1 and validfrom <= timestamp '{AS_OF}' and timestamp '{AS_OF}' < validto"


@query(f"select id, identifier, idtype, pseudonym from pseudonym where {_VALID} and (identifier ilike '%300%' or idtype ilike '%300%' or pseudonym ilike '%300%') and (identifier ilike '%-id%' or idtype ilike '%-id%' or pseudonym ilike '%-id%')")
def search_pseudonyms(spark, folder):
    return search.pseudonyms(pseudonyms(spark, folder), "300 -id", 1, moment()).select("id", "identifier", "idtype", "pseudonym")


@query(f"select id, identifier, idtype from pseudonym where {_VALID} order by identifier, idtype, id limit 500")
def search_star(spark, folder):
    return search.pseudonyms(pseudonyms(spark, folder), "*", 1, moment()).select("id", "identifier", "idtype")


@query("select id, name from pseudonym_domain where contains(lower(name), 'labor') or contains(lower(prefix), 'labor') or contains(lower(description), 'labor') order by name, id limit 20")
def search_domains(spark, folder):
    return search.domains(domains(spark, folder), " LABOR ", most=20).select("id", "name")


@query("select id, concat_ws(', ', 'identifier: ' || identifier, 'idType: ' || idtype, 'psn: ' || pseudonym, 'domain: ' || domainid::varchar) text from pseudonym")
def representation(spark, folder):
    return pseudonyms(spark, folder).select("id", present.representation(["identifier", "idtype", "pseudonym", "domainid"], ["identifier", "idType", "psn", "domain"]).alias("text"))


@query("select id, name, prefix, validfrom, validto, description, superdomainid from pseudonym_domain")
def reduced_view(spark, folder):
    return present.reduced(domains(spark, folder), present.DOMAIN_VIEW)


@query("select id, case when domainid % 2 = 0 then validfrom end validfrom, case when domainid % 2 = 0 then domainid end domainid, identifier, idtype, pseudonym from pseudonym")
def permitted_view(spark, folder):
    rows = pseudonyms(spark, folder).select("id", "identifier", "idtype", "pseudonym", "validfrom", "domainid")
    return present.reduced(rows, present.PSEUDONYM_VIEW, permitted=F.col("domainid") % 2 == 0)


@query("select name, algorithm as value from pseudonym_domain")
def domain_attribute(spark, folder):
    return present.attribute(domains(spark, folder), "Algorithm", complete_view=True)


@query("select id, attribute, value from (unpivot (select id, name::varchar as name, prefix::varchar prefix, algorithm::varchar algorithm, alphabet::varchar alphabet from pseudonym_domain) on name, prefix, algorithm, alphabet into name attribute value value)")
def domain_attributes(spark, folder):
    return present.unpivoted(domains(spark, folder), "id", ["name", "prefix", "algorithm", "alphabet"])


@query("select id, user_name is null or regexp_full_match(user_name, '\\s*') blank from audit_event")
def blank_names(spark, folder):
    from veilframe.functions.normalize import blank

    return table(spark, folder, "audit_event").select("id", blank(F.col("user_name")).alias("blank"))


@query("select id, regexp_full_match(name, '[A-Za-z][A-Za-z0-9_\\-]*') good_name, regexp_full_match(version, '[0-9]+(\\.[0-9]+)*') good_version from entity_type")
def name_predicates(spark, folder):
    from veilframe.functions.normalize import TYPE_NAME, VERSION

    return table(spark, folder, "entity_type").select("id", F.col("name").rlike(TYPE_NAME).alias("good_name"), F.col("version").rlike(VERSION).alias("good_version"))


@query("""with r as (select id, case when id % 5 <> 0 then user_name end i, case when id % 3 <> 0 then topic end t, source_system d, requester_ip p from audit_event),
b as (select id, coalesce(trim(i, e' \\t'), '') = '' bi, coalesce(trim(t), '') = '' bt, coalesce(trim(d), '') = '' bd, coalesce(trim(p), '') = '' bp from r)
select id, case when bd then 'no domain' when (bi or bt) and bp and bi <> bt then 'half an identifier' when (bi or bt) and bp then 'neither identifier nor pseudonym' end reason from b""")
def request_validation(spark, folder):
    reason = present.usable_request(F.when(F.col("id") % 5 != 0, F.col("user_name")), F.when(F.col("id") % 3 != 0, F.col("topic")), F.col("source_system"), F.col("requester_ip"))
    return table(spark, folder, "audit_event").select("id", reason.alias("reason"))


# Batches

_BATCH = "with held as (select * from pseudonym where validfrom < timestamp '2020-01-01'), req as (select id request, domainid, identifier, idtype, pseudonym from pseudonym where not coalesce(validfrom < timestamp '2020-01-01', false))"
_CLASSIFIED = _BATCH + """, a as (select r.*, exists (select 1 from held h where h.domainid = r.domainid and h.identifier = r.identifier and h.idtype = r.idtype) or row_number() over (partition by domainid, identifier, idtype order by request) > 1 same_id,
  exists (select 1 from held h where h.domainid = r.domainid and h.pseudonym = r.pseudonym) has_psn from req r),
b as (select *, sum(case when not same_id and not has_psn then 1 else 0 end) over (partition by domainid, pseudonym order by request rows unbounded preceding) k from a),
c as (select request, case when same_id then 'duplicate identifier' when has_psn or k > 1 then 'duplicate pseudonym' else 'success' end status from b) """


def _batch(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = pseudonyms(spark, folder)
    early = F.coalesce(F.col("validfrom") < F.expr("timestamp_ntz'2020-01-01'"), F.lit(False))
    return rows.where(~early).select(F.col("id").alias("request"), "domainid", "identifier", "idtype", "pseudonym"), rows.where(early)


@query(_CLASSIFIED + "select * from c")
def create_classify(spark, folder):
    requests, held = _batch(spark, folder)
    return classify.create(requests, held).select("request", "status")


@query(_CLASSIFIED + "select status, count(*) n from c group by 1")
def batch_status(spark, folder):
    requests, held = _batch(spark, folder)
    return classify.outcome(classify.create(requests, held))


_CHANGES = "with ch as (select id request, domainid, pseudonym old_pseudonym, 'N-' || identifier new_identifier, timestamp '2030-01-01' new_validto from pseudonym where domainid % 2 = 0), u as (select ch.request, min(p.id) id from ch join pseudonym p on p.domainid = ch.domainid and p.pseudonym = ch.old_pseudonym group by 1 having count(*) = 1), one as (select id, min(request) request from u group by 1) "


def _changes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    held = pseudonyms(spark, folder)
    changes = held.where("domainid % 2 = 0").select(F.col("id").alias("request"), "domainid", F.lit(None).cast("string").alias("old_identifier"), F.lit(None).cast("string").alias("old_idtype"), F.col("pseudonym").alias("old_pseudonym"), F.concat(F.lit("N-"), "identifier").alias("new_identifier"), F.expr("timestamp_ntz'2030-01-01'").alias("new_validto"))
    return changes, held


@query(_CHANGES + "select p.id, case when one.id is not null then 'N-' || p.identifier else p.identifier end identifier, case when one.id is not null then timestamp '2030-01-01' else p.validto end validto from pseudonym p left join one on one.id = p.id")
def update_merge(spark, folder):
    changes, held = _changes(spark, folder)
    return classify.update(changes, held)[1].select("id", "identifier", "validto")


@query(_CHANGES + "select ch.request, one.id is not null updated from ch left join one on one.request = ch.request")
def update_flags(spark, folder):
    return classify.update(*_changes(spark, folder))[0]


_GONE = "with r as (select id request, identifier, idtype, case when id % 2 = 0 then pseudonym else pseudonym || '?' end pseudonym, domainid from pseudonym where domainid % 3 = 0) "


def _gone(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    held = pseudonyms(spark, folder)
    requests = held.where("domainid % 3 = 0").select(F.col("id").alias("request"), "identifier", "idtype", F.when(F.col("id") % 2 == 0, F.col("pseudonym")).otherwise(F.concat("pseudonym", F.lit("?"))).alias("pseudonym"), "domainid")
    return requests, held


@query(_GONE + "select request, exists (select 1 from pseudonym p where p.identifier = r.identifier and p.idtype = r.idtype and p.pseudonym = r.pseudonym and p.domainid = r.domainid) deleted from r")
def delete_flags(spark, folder):
    return classify.delete(*_gone(spark, folder))[0]


@query(_GONE + "select id from pseudonym p where not exists (select 1 from r where p.identifier = r.identifier and p.idtype = r.idtype and p.pseudonym = r.pseudonym and p.domainid = r.domainid)")
def delete_rest(spark, folder):
    return classify.delete(*_gone(spark, folder))[1].select("id")


@query("select p.id, (p.id % 2 = 0) or (p.identifier is not null and p.idtype is not null and not d.multiplepsnallowed) may from pseudonym p join pseudonym_domain d on d.id = p.domainid")
def update_eligible(spark, folder):
    rows = pseudonyms(spark, folder).join(domains(spark, folder).select(F.col("id").alias("domainid"), "multiplepsnallowed"), "domainid")
    old = F.when(F.col("id") % 2 == 0, F.col("pseudonym"))
    return rows.select("id", classify.may_update(old, F.col("identifier"), F.col("idtype"), F.col("multiplepsnallowed")).alias("may"))


# The tree of domains

_UP = "with recursive up(id, ancestor, distance) as (select id, id, 0 from pseudonym_domain union all select up.id, d.superdomainid, up.distance + 1 from up join pseudonym_domain d on d.id = up.ancestor where d.superdomainid is not null), top as (select id, arg_max(ancestor, distance) root from up group by 1) "
_DOWN = "with recursive t(id, name, superdomainid, depth) as (select id, name, superdomainid, 0 from pseudonym_domain where lower(name) = 'nordlicht' union all select c.id, c.name, c.superdomainid, t.depth + 1 from pseudonym_domain c join t on c.superdomainid = t.id) "


@query(_DOWN + "select * from t")
def domain_subtree(spark, folder):
    return tree.subtree(domains(spark, folder), " Nordlicht ")


@query(_UP + "select * from top")
def domain_roots(spark, folder):
    return tree.roots(domains(spark, folder))


@query(_UP + "select d.id, d.name from pseudonym_domain d join top using (id) where root = (select root from top join pseudonym_domain using (id) where lower(name) = 'nordlicht-labor')")
def domain_root_tree(spark, folder):
    return tree.whole_tree(domains(spark, folder), "Nordlicht-Labor").select("id", "name")


@query("with recursive t(id, name, depth, path) as (select id, name, 0, name from pseudonym_domain where superdomainid is null union all select c.id, c.name, t.depth + 1, t.path || '/' || c.name from pseudonym_domain c join t on c.superdomainid = t.id) select * from t")
def domain_hierarchy(spark, folder):
    return tree.hierarchy(domains(spark, folder))


@query(_UP + """, m as (select a.id source, b.id target, arg_min(a.ancestor, a.distance) lca, min(a.distance) da from up a join up b on a.ancestor = b.ancestor group by 1, 2)
select x.id source, y.id target, case when m.lca is null then '' else array_to_string(list_concat((select list(ancestor order by distance) from up where up.id = x.id and distance <= m.da), (select coalesce(list(ancestor order by distance desc), []) from up where up.id = y.id and distance < (select distance from up z where z.id = y.id and z.ancestor = m.lca))), ',') end path
from (select id, unnest([1, 3, 7]) t from pseudonym_domain) x join pseudonym_domain y on y.id = x.t left join m on m.source = x.id and m.target = y.id""")
def domain_paths(spark, folder):
    pairs = domains(spark, folder).select(F.col("id").alias("source"), F.explode(F.array(F.lit(1), F.lit(3), F.lit(7))).alias("target"))
    return tree.paths(domains(spark, folder), pairs).select("source", "target", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query("select id domainid, case when exists (select 1 from pseudonym_domain d where d.id = w.id) then (select count(*) from pseudonym p where p.domainid = w.id) else -1 end amount from (select id from pseudonym_domain union all select 9999) w(id)")
def domain_counts(spark, folder):
    wanted = domains(spark, folder).select(F.col("id").alias("domainid")).unionByName(spark.range(1).select(F.lit(9999).alias("domainid")))
    return tree.counts(domains(spark, folder), pseudonyms(spark, folder), wanted)


@query("select 'N-' || d.name as name, d.superdomainid parent, coalesce(case when d.id % 2 = 0 then d.algorithm end, p.algorithm, 'RANDOM_LET') algorithm, (d.id % 2 <> 0 and p.id is not null) algorithminherited, coalesce(case when d.id % 3 = 0 then d.pseudonymlength end, p.pseudonymlength, 10) pseudonymlength, (d.id % 3 <> 0 and p.id is not null) pseudonymlengthinherited from pseudonym_domain d left join pseudonym_domain p on p.id = d.superdomainid")
def inherit_create(spark, folder):
    d = domains(spark, folder)
    requests = d.select(F.concat(F.lit("N-"), "name").alias("name"), F.col("superdomainid").alias("parent"), F.when(F.col("id") % 2 == 0, F.col("algorithm")).alias("algorithm"), F.when(F.col("id") % 3 == 0, F.col("pseudonymlength")).alias("pseudonymlength"))
    return tree.inherit_at_creation(requests, d, {"algorithm": F.lit("RANDOM_LET"), "pseudonymlength": F.lit(10)})


@query("with recursive d as (select id, superdomainid, case when id = 1 then 'SHA3' else algorithm end own, coalesce(algorithminherited, false) and id <> 1 takes from pseudonym_domain), t(id, value) as (select id, own from d where superdomainid is null union all select c.id, case when c.takes then t.value else c.own end from d c join t on c.superdomainid = t.id) select * from t")
def inherit_cascade(spark, folder):
    return tree.cascade(domains(spark, folder), "algorithm", {1: "SHA3"})


@query(_DOWN + "select id from pseudonym p where domainid not in (select id from t)")
def domain_delete(spark, folder):
    return tree.without(domains(spark, folder), "Nordlicht", pseudonyms=pseudonyms(spark, folder))["pseudonyms"].select("id")


@query(_DOWN + "select id, name from pseudonym_domain where id not in (select id from t)")
def domain_delete_tree(spark, folder):
    return tree.without(domains(spark, folder), "Nordlicht")["domains"].select("id", "name")


# Linked pseudonyms

_HOP = "(p{a}.pseudonym = p{b}.identifier or p{a}.identifier = p{b}.pseudonym)"


@query(f"select p1.id source_id, p2.id target_id from pseudonym p1 join pseudonym p2 on {_HOP.format(a=1, b=2)} where p1.domainid = 1 and p2.domainid = 2")
def linked_pseudonyms(spark, folder):
    return linked.linked(pseudonyms(spark, folder), F.col("domainid") == 1, 1, 2)


@query(f"select p1.id source_id, p3.id target_id from pseudonym p1 join pseudonym p2 on {_HOP.format(a=1, b=2)} join pseudonym p3 on {_HOP.format(a=2, b=3)} where p1.domainid = 1 and p3.domainid = 3")
def linked_pseudonyms_chain3(spark, folder):
    return linked.linked(pseudonyms(spark, folder), F.col("domainid") == 1, 2, 3)


@query("""with recursive t(id, depth) as (select id, 0 from pseudonym_domain where lower(name) = 'nordlicht' union all select c.id, t.depth + 1 from pseudonym_domain c join t on c.superdomainid = t.id),
c as (select p.identifier uid, p.*, 0 depth from pseudonym p where domainid = (select id from t where depth = 0) and idtype = 'HOSP-ID' union all select c.uid, p.*, c.depth + 1 from c join pseudonym p on (c.pseudonym = p.identifier or c.identifier = p.pseudonym) join t on t.id = p.domainid and t.depth = c.depth + 1)
select distinct uid instance_uid, pseudonym, domainid from c""")
def instance_pseudonyms(spark, folder):
    """Everything known of the identifiers of one type, down the tree; identifiers stand for instance uids here."""
    uids = pseudonyms(spark, folder).where("idtype = 'HOSP-ID'").select(F.col("identifier").alias("instance_uid")).distinct()
    return linked.of_instances(uids, pseudonyms(spark, folder), domains(spark, folder), "Nordlicht", "HOSP-ID")


@query("select p.id, case when p.id % 3 = 0 then p.validfrom when d.enforcestartdatevalidity then greatest(timestamp '2019-01-01', d.validfrom) else timestamp '2019-01-01' end \"start\", case when p.id % 4 = 0 then p.validto when d.enforceenddatevalidity then least(timestamp '2050-01-01', d.validto) else timestamp '2050-01-01' end \"end\" from pseudonym p join pseudonym_domain d on d.id = p.domainid")
def validity_update(spark, folder):
    d = domains(spark, folder).select(F.col("id").alias("domainid"), F.col("validfrom").alias("df"), F.col("validto").alias("dt"), F.col("enforcestartdatevalidity").alias("es"), F.col("enforceenddatevalidity").alias("ee"))
    rows = pseudonyms(spark, folder).join(d, "domainid")
    start, end = F.when(F.col("id") % 3 != 0, F.expr("timestamp_ntz'2019-01-01'")), F.when(F.col("id") % 4 != 0, F.expr("timestamp_ntz'2050-01-01'"))
    return rows.select("id", validity.updated_start(start, F.col("validfrom"), F.col("df"), F.col("es")).alias("start"), validity.updated_end(end, F.col("validto"), F.col("dt"), F.col("ee")).alias("end"))


_COMPLETE = _BY_DOMAIN.replace("select c.*, d.*,", "select c.*,").replace("p.identifier || p.idtype", "p.identifier || '-2' || p.idtype").replace("where p.identifier is not null", "where p.id % 2 = 0 and p.identifier is not null")


@query(_COMPLETE + f"""select p.id, case when p.id % 2 = 0 then p.identifier || '-2' else p.identifier end identifier,
case when p.id % 2 = 1 or p.identifier is null or p.idtype is null then p.pseudonym when b.h is not null then b.prefix || case when c then b.b || case b.algorithm when 'CONSECUTIVE' then {check_sql('b.b', luhn.MOD10)} else {check_sql('b.b', luhn.MOD16)} end else h end end pseudonym
from pseudonym p left join b on b.id = p.id""")
def update_complete(spark, folder):
    """Complete updates of every other row's identifier: its domain makes the pseudonym anew, whatever the algorithm.
    What SQL can't hash (or is drawn) is null here and tested by itself."""
    held = pseudonyms(spark, folder)
    changes = held.where("id % 2 = 0 and identifier is not null and idtype is not null").select("id", F.concat("identifier", F.lit("-2")).alias("new_identifier"))
    made = classify.complete(changes, held, lambda rows: P.by_domain(rows, domains(spark, folder), order="id"))
    kinds = domains(spark, folder).select(F.col("id").alias("domainid"), F.upper(F.trim("algorithm")).isin("MD5", "SHA1", "CONSECUTIVE").alias("known"))
    return made.join(kinds, "domainid", "left").select("id", "identifier", F.when(F.col("known") | (F.col("id") % 2 == 1), F.col("pseudonym")).alias("pseudonym"))


@query("select d.id, p.name parent_name from pseudonym_domain d left join pseudonym_domain p on p.id = d.superdomainid")
def domain_labels(spark, folder):
    from veilframe.operators.entities import domain_labels as labels

    return labels(domains(spark, folder)).select("id", "parent_name")


@query("select id, case when id = 3 then 7 else consecutivevaluecounter end consecutivevaluecounter, case when id = 3 then 'new salt' else salt end salt from pseudonym_domain")
def domain_settings(spark, folder):
    from veilframe.operators.entities import set_domain

    return set_domain(domains(spark, folder), 3, consecutivevaluecounter=7, salt="new salt").select("id", "consecutivevaluecounter", "salt")
