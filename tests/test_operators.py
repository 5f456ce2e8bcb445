"""Edge cases of the operators: nulls, ties, repeated rows, empty tables, clashing columns."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilframe.operators import audit, classify, creation, entities, linkage as L, linked, lookup, permissions as M, present, pseudonymize as P, schema, search, tree
from veilframe.functions import luhn
from veilframe.queries import records

HELD = "domainid int, identifier string, idtype string, pseudonym string"
FOREST = [(1, "Root", None), (2, "A", 1), (3, "B", 1), (4, "AA", 2), (9, "Other", None), (10, "Orphan", 77)]


@pytest.fixture(scope="module")
def forest(spark):
    return spark.createDataFrame(FOREST, "id int, name string, superdomainid int")


@pytest.mark.parametrize("hot", [1, 10_000])
def test_hot_keys_have_one_winner(spark, hot):
    requests = spark.range(40).select(F.col("id").alias("request"), F.lit(1).alias("domainid"), F.when(F.col("id") < 30, None).otherwise("i").alias("identifier"), F.lit("t").alias("idtype"), F.col("id").cast("string").alias("pseudonym")).repartition(5)
    got = classify.create(requests, spark.createDataFrame([], HELD), hot_rows=hot)
    assert sorted(r.request for r in got.where("status = 'success'").collect()) == [0, 30] and got.count() == 40


def test_create_classifies_against_what_is_held_and_within_the_batch(spark):
    held = spark.createDataFrame([(1, "i1", "t", "p1"), (1, "i1", "t", "p1"), (2, "i9", "t", "p9")], HELD)
    rows = [(1, 1, "i1", "t", "new"), (2, 1, "i2", "t", "p1"), (3, 1, "i3", "t", "p3"), (4, 1, "i3", "t", "p4"), (5, 1, "i5", "t", "p3"), (6, 2, "i1", "t", "p1"), (7, 1, None, "t", "p7"), (8, None, "i8", "t", None)]
    requests = spark.createDataFrame(rows, "request int, domainid int, identifier string, idtype string, pseudonym string").withColumn("status_note", F.lit("extra"))
    got = {r.request: r.status for r in classify.create(requests, held).collect()}
    assert got == {1: classify.SAME_IDENTIFIER, 2: classify.SAME_PSEUDONYM, 3: classify.SUCCESS, 4: classify.SAME_IDENTIFIER, 5: classify.SAME_PSEUDONYM, 6: classify.SUCCESS, 7: classify.SUCCESS, 8: classify.SUCCESS}
    several = {r.request: r.status for r in classify.create(requests, held, multiple=True).collect()}
    assert several[1] == classify.SUCCESS and several[4] == classify.SUCCESS
    results = classify.create(requests, held)
    assert classify.reply(results) == 206 and classify.reply(results.where("status = 'success'")) == 201 and classify.reply(results.limit(0)) == 422
    again = held.unionByName(results.where("status = 'success'").select(*held.columns))
    assert set(r.status for r in classify.create(results.where("status = 'success' and identifier is not null and domainid is not null").drop("status"), again).collect()) == {classify.SAME_IDENTIFIER}


def test_update_needs_one_row(spark):
    held = spark.createDataFrame([(1, 1, "i", "t", "p"), (2, 1, "i", "t", "q"), (3, 1, "j", "t", "r")], "id int, " + HELD)
    rows = [(1, 1, None, None, "p", "x"), (2, 1, "i", "t", None, "y"), (3, 1, "j", "t", None, None), (4, 1, "other", None, "q", "z"), (5, 1, None, None, "p", "late")]
    changes = spark.createDataFrame(rows, "request int, domainid int, old_identifier string, old_idtype string, old_pseudonym string, new_identifier string")
    flags, state = classify.update(changes, held)
    assert {r.request: r.updated for r in flags.collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    assert {r.id: r.identifier for r in state.collect()} == {1: "x", 2: "i", 3: "j"}


def test_retries_end(spark):
    requests = spark.range(60).select(F.col("id").alias("request"), F.lit(1).alias("domainid"), F.col("id").cast("string").alias("identifier"), F.lit("t").alias("idtype"))
    draw = lambda some, k: some.withColumn("pseudonym", F.pmod(F.xxhash64("request", F.lit(k)), F.lit(40)).cast("string"))
    done = classify.create_with_retries(requests, spark.createDataFrame([], HELD), draw)
    rows = done.collect()
    good = [r.pseudonym for r in rows if r.status == classify.SUCCESS]
    assert len(rows) == 60 and len(good) == len(set(good)) <= 40 and len(good) > 30


def test_numbering_is_dense_and_ordered(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("id"), F.lit("x").alias("_n"))
    got = {r.id: r.k for r in P.numbered(rows, ["id"], 10, "k").collect()}
    assert got == {i: i + 11 for i in range(500)}


@pytest.mark.parametrize("name", ["RANDOM_NUM", "RANDOM_HEX", "RANDOM_LET", "RANDOM_SYM", "RANDOM_SYM_BIOS", "RANDOM", "NOTHING_KNOWN"])
@pytest.mark.parametrize("seed", [None, 5])
def test_random_pseudonyms(spark, name, seed):
    known = name != "NOTHING_KNOWN"
    scheme = P.Scheme(name, prefix="R-", length=12, check_digit=known)
    rows = spark.range(50).select(F.col("id").cast("string").alias("identifier"), F.lit("t").alias("idtype"))
    made = P.pseudonymize(rows, scheme, seed=seed)
    if known:
        made = made.withColumn("ok", luhn.valid(F.col("psn"), F.lit("R-"), luhn.check_alphabet(name, scheme.signs)))
        assert all(r.ok for r in made.collect())
    texts = [r.psn for r in made.collect()]
    assert len(set(texts)) == 50 and all(t.startswith("R-") and len(t) == (15 if known else 14) and set(t[2:]) <= set(scheme.signs) for t in texts)
    assert (texts == [r.psn for r in made.collect()]) == (seed is not None)


def every_algorithm(spark):
    """A domain per algorithm, with and without check digit and several pseudonyms; one without, one unknown algorithm."""
    rows, n = [], 0
    for algorithm in ["MD5", " sha1", "SHA2", "SHA3", "BLAKE3", "XXHASH", "CONSECUTIVE", "RANDOM", "RANDOM_NUM", "RANDOM_HEX", "RANDOM_LET", "RANDOM_SYM", "RANDOM_SYM_BIOS", "WHO_KNOWS", " ", None]:
        for digit, included, several in ((False, False, False), (True, False, True), (True, True, False)):
            n += 1
            signs = "ABCDEF" if algorithm == "RANDOM" else "0123456789"
            rows.append((n, f"D{n}", f"P{n}-", algorithm, signs, several, 20, "0", digit, included, 100 if n % 2 else None, f"salt {n}" if n % 3 else None))
    return spark.createDataFrame(rows, "id int, name string, prefix string, algorithm string, alphabet string, multiplepsnallowed boolean, pseudonymlength int, paddingcharacter string, addcheckdigit boolean, lengthincludescheckdigit boolean, consecutivevaluecounter long, salt string")


def brute_pseudonym(d, identifier, idtype, rank):
    """The text before the check digit (None: drawn), by the libraries."""
    import hashlib

    import xxhash as library
    from veilframe.functions.blake3 import blake3_hex

    name = d.algorithm.strip().upper()
    text, count = identifier + idtype + (d.salt or ""), (d.consecutivevaluecounter or 0) + rank
    if d.multiplepsnallowed:
        text += str(count - 1)
    if name == "CONSECUTIVE":
        raw = str(count)
    elif name == "BLAKE3":
        raw = blake3_hex([text])[0].upper()
    elif name == "XXHASH":
        raw = library.xxh64(text.encode(), seed=int.from_bytes(hashlib.sha256(d.salt.encode()).digest()[:8], "big") if d.salt else 0).hexdigest()
    elif name in ("MD5", "SHA1", "SHA2", "SHA3"):
        raw = {"MD5": hashlib.md5, "SHA1": hashlib.sha1, "SHA2": hashlib.sha512, "SHA3": hashlib.sha3_512}[name](text.encode()).hexdigest().upper()
    else:
        return None
    return d.prefix + raw.rjust(d.pseudonymlength, d.paddingcharacter)[: d.pseudonymlength]


def test_pseudonyms_of_every_algorithm_by_domain(spark):
    domains = every_algorithm(spark)
    asked = [(k, d, f"i{k}", "T") for k, d in enumerate([d for d in range(1, 49) for _ in range(3)])] + [(900, 1, None, "T"), (901, 7, "x", None), (902, 99, "x", "T"), (903, None, "x", "T")]
    rows = spark.createDataFrame(asked, "request long, domainid int, identifier string, idtype string").withColumn("_n", F.lit("clash")).drop("_n")
    made = {r.request: r for r in P.by_domain(rows, domains, order="request").collect()}
    assert set(made) == {a[0] for a in asked} and all(made[k].psn is None for k in (900, 901, 902, 903))
    ranks = {}
    for d in domains.collect():
        known = d.algorithm is not None and d.algorithm.strip() != ""
        name = d.algorithm.strip().upper() if known else ""
        for request, domain, identifier, idtype in asked[:-4]:
            if domain != d.id:
                continue
            got = made[request].psn
            if not known:
                assert got is None
                continue
            ranks[d.id] = ranks.get(d.id, 0) + 1
            want = brute_pseudonym(d, identifier, idtype, ranks[d.id])
            body = got[: len(d.prefix) + d.pseudonymlength - (d.lengthincludescheckdigit and name != "CONSECUTIVE")]
            if want is not None:
                assert body == want[: len(body)]
            signs = P.Scheme(d.algorithm, alphabet=d.alphabet).signs if want is None else None
            assert signs is None or set(body[len(d.prefix) :]) <= set(signs)
            kind = name if name in [*P.HASHING, *P.DRAWING, "CONSECUTIVE"] else "RANDOM_LET"
            if d.addcheckdigit:
                alphabet = luhn.check_alphabet(kind, d.alphabet)
                total = sum((lambda v: v // len(alphabet) + v % len(alphabet))((2 - k % 2) * alphabet.index(c)) for k, c in enumerate(reversed(body[len(d.prefix) :].upper())))
                assert got == body + alphabet[-total % len(alphabet)]
            else:
                assert got == body
    after = {r.id: r.consecutivevaluecounter for r in P.advanced(domains, P.by_domain(rows, domains, order="request").where("psn is not null")).collect()}
    counting = lambda d: (d.algorithm or "").strip().upper() == "CONSECUTIVE" or (d.multiplepsnallowed and (d.algorithm or "").strip().upper() in P.HASHING)
    assert after == {d.id: (d.consecutivevaluecounter or 0) + 3 if counting(d) else d.consecutivevaluecounter for d in domains.collect()}


def test_creation_in_domains(spark):
    """Unknown and ended domains, no pseudonym, supplied ones, several per identifier, and drawing again in a full space."""
    kinds = [(1, "P-", "RANDOM", "AB", 2, False, None), (2, "C-", "CONSECUTIVE", "0123456789", 4, True, 7), (3, "E-", "MD5", "", 8, False, None), (4, "N-", None, "", 8, False, None)]
    domains = spark.createDataFrame(kinds, "id int, prefix string, algorithm string, alphabet string, pseudonymlength int, multiplepsnallowed boolean, consecutivevaluecounter long").selectExpr("*", "concat('D', id) name", "timestamp_ntz'2020-01-01' validfrom", "if(id = 3, timestamp_ntz'2021-01-01', timestamp_ntz'2030-01-01') validto", "true enforcestartdatevalidity", "true enforceenddatevalidity", "false addcheckdigit", "'0' paddingcharacter", "cast(null as string) salt")
    held = spark.createDataFrame([("a", "T", "P-AA", 1), ("c", "T", "C-0001", 2)], "identifier string, idtype string, pseudonym string, domainid int")
    asked = [(k, f"i{k}", "T", 1, None) for k in range(8)] + [(20, "a", "T", 1, None), (21, "c", "T", 2, None), (22, "c", "T", 2, None), (23, "x", "T", 3, None), (24, "x", "T", 4, None), (25, "x", "T", 5, None), (26, "y", "T", 2, " mine "), (27, "z", "T", 2, "C-0001")]
    requests = spark.createDataFrame(asked, "request long, identifier string, idtype string, domainid int, given string")
    results, after = creation.create(requests, domains, held, F.expr("timestamp_ntz'2024-01-01'"), seed=3)
    got = {r.request: r for r in results.collect()}
    assert len(got) == len(asked) == results.count()
    free = [got[k] for k in range(8) if got[k].status == classify.SUCCESS]
    assert len({r.pseudonym for r in free}) == len(free) <= 3 and all(r.pseudonym in ("P-AB", "P-BA", "P-BB") for r in free) and free
    assert {got[k].status for k in range(8)} <= {classify.SUCCESS, classify.SAME_PSEUDONYM}
    assert got[20].status == classify.SAME_IDENTIFIER and got[23].status == creation.EXPIRED and got[24].status == creation.NO_PSEUDONYM and got[25].status == creation.UNKNOWN_DOMAIN
    assert [(got[k].status, got[k].pseudonym) for k in (21, 22, 26, 27)] == [(classify.SUCCESS, "C-0008"), (classify.SUCCESS, "C-0009"), (classify.SUCCESS, "C-mine"), (classify.SAME_PSEUDONYM, "C-0001")]
    assert {r.id: r.consecutivevaluecounter for r in after.collect()} == {1: None, 2: 9, 3: None, 4: None}
    assert all(r.pseudonym is not None for r in got.values() if r.status in (classify.SUCCESS, classify.SAME_PSEUDONYM, classify.SAME_IDENTIFIER))


@pytest.mark.parametrize("few", [0, 100])
def test_near_keeps_what_requests_meet(spark, few):
    held = spark.createDataFrame([("a", "T", "1", 1), ("b", "T", "2", 1), ("a", "T", "3", 2), ("c", "U", "4", 1)], "identifier string, idtype string, pseudonym string, domainid int")
    asked = spark.createDataFrame([("a", "T", "9", 1), ("x", "T", "4", 1)], held.schema)
    got = {r.pseudonym for r in classify.near(held, asked, few).collect()}
    assert got == ({"1", "4"} if few else {"1", "2", "3", "4"})


def test_deep_trees_strange_names_and_cycles(spark):
    chain = spark.createDataFrame([(k, f"d{k}" if k != 60 else "it's \\", k - 1 if k else None) for k in range(130)], "id int, name string, superdomainid int")
    assert sorted(r.depth for r in tree.hierarchy(chain).collect()) == list(range(130))
    below = tree.subtree(chain, " IT'S \\ ").collect()
    assert len(below) == 70 and max(r.depth for r in below) == 69 and tree.subtree(chain, "' or 1=1 --").count() == 0
    with pytest.raises(ValueError):
        tree.roots(spark.createDataFrame([(1, "a", 2), (2, "b", 1), (3, "c", None)], chain.schema))


def test_inherited_validity(spark):
    domains = spark.sql("select 1 id, timestamp_ntz'2020-01-01' validfrom, timestamp_ntz'2030-01-01' validto")
    rows = spark.sql("select * from values (1, timestamp_ntz'2000-01-01', true, timestamp_ntz'2001-01-01', false, 1), (2, timestamp_ntz'2000-01-01', null, timestamp_ntz'2001-01-01', true, 1), (3, timestamp_ntz'2000-01-01', true, timestamp_ntz'2001-01-01', true, 9) t(id, validfrom, validfrominherited, validto, validtoinherited, domainid)")
    assert {r.id: (r.validfrom.year, r.validto.year) for r in tree.inherited_validity(rows, domains).collect()} == {1: (2020, 2001), 2: (2000, 2030), 3: (2000, 2001)}


def test_hash_of_null_identifier_is_null(spark):
    rows = spark.createDataFrame([(None, "t"), ("i", None), ("", "")], "identifier string, idtype string")
    assert [r.psn is None for r in P.pseudonymize(rows, P.Scheme("MD5")).collect()] == [True, True, False]


def test_domain_names(spark, forest):
    twice = forest.unionByName(spark.createDataFrame([(5, "ROOT", None)], forest.schema))
    names = spark.createDataFrame([(" root ",), ("a",), (None,), ("zz",)], "wanted string")
    assert {r.wanted: r.id for r in lookup.one_by_name(twice, names).collect()} == {" root ": None, "a": 2, None: None, "zz": None}


def test_export_has_a_cap(spark):
    rows = spark.range(10).select(F.lit(1).alias("domainid"))
    assert lookup.export(rows, 1, 10).count() == 10 and lookup.export(rows, 2, 0).count() == 0
    with pytest.raises(lookup.TooManyRows):
        lookup.export(rows, 1, 9)


def test_tree(spark, forest):
    assert {(r.id, r.depth) for r in tree.subtree(forest, " ROOT").collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    pairs = spark.createDataFrame([(4, 3), (4, 4), (1, 4), (4, 9), (4, 500), (None, 1)], "source int, target int")
    ways = {(r.source, r.target): r.path for r in tree.paths(forest, pairs).collect()}
    assert ways == {(4, 3): [4, 2, 1, 3], (4, 4): [4], (1, 4): [1, 2, 4], (4, 9): [], (4, 500): None, (None, 1): None}
    rows = [tuple(r) for r in forest.collect()]
    assert tree.path_names(rows, "AA", "B") == ["AA", "A", "Root", "B"] and tree.path_names(rows, "AA", "Other") == [] and tree.path_names(rows, "aa", "B") is None
    shape = tree.nested(rows)
    assert [n["name"] for n in shape] == ["Orphan", "Other", "Root"] and [c["name"] for c in shape[2]["children"]] == ["A", "B"]
    assert {r.name: r.depth for r in tree.hierarchy(forest).collect()} == {"Root": 0, "A": 1, "B": 1, "AA": 2, "Other": 0, "Orphan": 0}
    assert [r.name for r in tree.flat_names(forest, "aa").collect()] == ["A", "AA", "B", "Root"]


def test_cascade_stops_at_own_values(spark):
    rows = [(1, None, 30, False), (2, 1, 30, True), (3, 2, 7, False), (4, 3, 7, True), (5, 2, 30, True)]
    d = spark.createDataFrame(rows, "id int, superdomainid int, pseudonymlength int, pseudonymlengthinherited boolean")
    assert {r.id: r.value for r in tree.cascade(d, "pseudonymlength", {1: 12}).collect()} == {1: 12, 2: 12, 3: 7, 4: 7, 5: 12}
    assert {r.id: r.value for r in tree.cascade(d, "pseudonymlength", {2: 5}).collect()} == {1: 30, 2: 5, 3: 7, 4: 7, 5: 5}


def test_deleting_a_domain(spark, forest):
    psn = spark.createDataFrame([(1, 4), (2, 9), (3, None)], "id int, domainid int")
    grants = spark.createDataFrame([("DOMAIN", 2), ("PROJECT", 2), ("DOMAIN", 9)], "resource_type string, resource_id int")
    kept = tree.without(forest, "a", pseudonyms=psn, grants=grants)
    assert {r.id for r in kept["domains"].collect()} == {1, 3, 9, 10} and {r.id for r in kept["pseudonyms"].collect()} == {2, 3}
    assert {tuple(r) for r in kept["grants"].collect()} == {("PROJECT", 2), ("DOMAIN", 9)}


def test_links_go_both_ways_once(spark):
    rows = [(1, "i", "t", "a", 1), (2, "a", "t", "b", 2), (3, "b", "t", "c", 3), (4, "x", "t", "i", 2), (5, "a", "t", "i", 2), (6, None, "t", None, 2)]
    p = spark.createDataFrame(rows, "id int, identifier string, idtype string, pseudonym string, domainid int")
    assert sorted((r.source_id, r.target_id) for r in linked.linked(p, F.col("id") == 1, 1, 2).collect()) == [(1, 2), (1, 4), (1, 5)]
    assert sorted((r.source_id, r.target_id) for r in linked.linked(p, F.col("id") == 1, 2, 3).collect()) == [(1, 3)]
    assert linked.linked(p, F.col("id") == 1, 2, 3, domains=[1, 9, 3]).count() == 0
    plan = linked.linked(p, F.col("domainid") == 1, 2, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_search_wildcards_and_nulls(spark):
    rows = spark.createDataFrame([(1, "ab_c", "T", None, 1), (2, "abxc", None, "p", 1)], "id int, identifier string, idtype string, pseudonym string, domainid int").withColumn("validfrom", F.expr("timestamp_ntz'2020-01-01'")).withColumn("validto", F.expr("timestamp_ntz'2030-01-01'"))
    now = F.expr("timestamp_ntz'2025-01-01'")
    find = lambda q: [r.id for r in search.pseudonyms(rows, q, 1, now).collect()]
    assert find("b_c") == [1, 2] and find("B t") == [1] and find("*") == [1, 2] and find("zz") == [] and find("") == [1, 2]
    assert search.truncated(rows, 1)[1] and not search.truncated(rows, 2)[1]


def test_literal_domain_search(spark):
    d = spark.createDataFrame([(1, "a%b", None, None), (2, "aXb", "P", "x")], "id int, name string, prefix string, description string")
    assert [r.id for r in search.domains(d, "A%B").collect()] == [1] and [r.id for r in search.domains(d, "*", visible=d.where("id = 2")).collect()] == [2]


def test_contained_json_compares_types(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x"}}'), (2, '{"a": "1", "b": {"c": "x"}}'), (3, "no"), (4, None)], "id int, data string")
    assert [r.id for r in search.contains_json(rows, {"a": 1, "b.c": "x"}).collect()] == [1] and [r.id for r in search.contains_json(rows, {"a": "1"}).collect()] == [2]


def test_attribute_needs_the_view(spark, forest):
    with pytest.raises(PermissionError):
        present.attribute(forest, "id")
    with pytest.raises(KeyError):
        present.attribute(forest, "nothing")
    assert present.attribute(forest, " NAME ").count() == 6
    assert present.attribute(forest, "id", complete_view=True).count() == 6


def test_grants(spark):
    t = lambda s: F.expr(f"timestamp'{s}'")
    rows = [("s", "DOMAIN", 1, "domain:read", "ALLOW", None, None), ("s", "DOMAIN", 1, "domain:manage-permissions", "ALLOW", "2020-01-01", "2030-01-01"), ("s", "DOMAIN", 1, "domain:update", "DENY", None, None), ("s", "DOMAIN", 1, "domain:delete", "ALLOW", "2020-01-01", "2025-01-01")]
    g = spark.createDataFrame(rows, "subject_id string, resource_type string, resource_id int, action string, decision string, f string, t string").withColumn("valid_from", F.col("f").cast("timestamp")).withColumn("valid_to", F.col("t").cast("timestamp"))
    assert {r.action for r in M.allowed_actions(g, t("2024-06-01")).collect()} == {"domain:read", "domain:manage-permissions", "domain:delete"}
    assert {r.action for r in M.allowed_actions(g, t("2025-01-01")).collect()} == {"domain:read", "domain:manage-permissions"}
    asks = spark.createDataFrame([(1, "s", "DOMAIN", 1, "domain:read"), (2, "s", "DOMAIN", 1, "domain:update"), (3, "s", "DOMAIN", 2, "domain:read"), (4, "s", "DOMAIN", 1, "project:read"), (5, None, "DOMAIN", 1, "domain:read")], "request int, requester string, resource_type string, resource_id int, action string")
    assert {r.request: r.allowed for r in M.delegable(asks, g, M.catalogue(spark), t("2024-06-01")).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_audit(spark):
    groups = spark.createDataFrame([(["/no-auditing", "/human-users"],), (["x"],), ([],), (None,)], "g array<string>")
    assert [r.k for r in groups.select(audit.user_type(F.col("g")).alias("k")).collect()] == ["HUMAN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    bodies = ["a b" * 3000, None, "", "a" + "ä" * 3000, "x" * 4096, "x" * 4097, "a\t b\n"]
    long = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, b string").select("k", audit.payload(F.col("b")).alias("p"))
    cut = lambda b: "".join((b.encode()[:4096].decode("utf-8", "replace") + "..." if len(b.encode()) > 4096 else b).split())
    assert {r.k: r.p for r in long.collect()} == {k: None if b is None else cut(b) for k, b in enumerate(bodies)}
    ip = spark.createDataFrame([("1.1.1.1, 2.2.2.2", None), ("unknown", " 3.3.3.3 "), (None, "")], "f string, r string").select(audit.client_ip(F.col("f"), F.col("r"), F.lit("9.9.9.9")).alias("ip"))
    assert [r.ip for r in ip.collect()] == ["1.1.1.1", "3.3.3.3", "9.9.9.9"]


DEFINITION = {
    "attributes": [
        {"layout": "group", "name": "person", "attributes": [
            {"name": "first", "type": "string", "required": True, "linkage": True, "tags": ["name.first"], "minLength": 2, "linkageConfig": {"normalizers": ["trim", "lower", "umlautFold"], "encoders": ["cologne"], "blocking": ["phonetic", "prefix3"], "weight": 2.0}},
            {"name": "birth", "type": "date", "required": True, "linkage": True}]},
        {"name": "phones", "type": "string", "repeatable": True, "pattern": "^[0-9]+$"},
        {"layout": "row", "attributes": [{"name": "sex", "type": "enum", "values": ["m", "f"]}, {"name": "age", "type": "integer", "minimum": 0, "maximum": 120, "required": True}]}],
    "recordLinkage": {"minScore": 5.0, "autoLinkOnCreate": True, "onMatch": "returnExisting"},
}


def test_definitions():
    assert schema.definition_errors(DEFINITION) == []
    bad = {"attributes": [{"name": "a", "type": "enum"}, {"name": "a", "type": "date", "minimum": 1}, {"layout": "row", "name": "r", "repeatable": True, "attributes": [{"name": "n", "type": "number", "minimum": 3, "maximum": 1, "values": []}]}, {"name": "z", "type": "thing"}]}
    assert len(schema.definition_errors(bad)) == 8
    assert schema.definition_errors({})


def test_instances(spark):
    good = {"person": {"first": "Ab", "birth": "2000-02-29"}, "phones": ["12"], "sex": "m", "age": 3}
    shape = schema.compiled(DEFINITION)
    assert schema.instance_errors(shape, good) == []
    cases = {"$.age: missing": {"age": None}, "$.x: unknown": {"x": 1}, "$.person.first: shorter than 2": {"person": {"first": "A", "birth": "2000-02-29"}}, "$.person.birth: no date": {"person": {"first": "Ab", "birth": "2001-02-29"}}, "$.phones[1]: not of the pattern": {"phones": ["1", "x"]}, "$.phones: not an array": {"phones": "1"}, "$.sex: not an allowed value": {"sex": "q"}, "$.age: above 120": {"age": 121}, "$.age: not of type integer": {"age": True}, "$.person: not an object": {"person": 3}}
    for message, change in cases.items():
        one = {k: v for k, v in {**good, **change}.items() if v is not None}
        assert schema.instance_errors(shape, one) == [message]
    types = spark.createDataFrame([(1, json.dumps(DEFINITION)), (2, None)], "id int, type_definition string")
    rows = spark.createDataFrame([(1, 1, json.dumps(good)), (2, 1, None), (3, 1, "x"), (4, 2, "{}"), (5, None, "{}")], "id long, entity_type_id int, data string")
    assert {r.id: len(r.errors) for r in schema.validate(rows, types).collect()} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 1}
    assert schema.spark_schema(DEFINITION).simpleString() == "struct<person:struct<first:string,birth:date>,phones:array<string>,sex:string,age:bigint>"


def test_specialisation():
    assert schema.specialisation_errors(DEFINITION, DEFINITION) == []
    loose = json.loads(json.dumps(DEFINITION))
    first = loose["attributes"][0]["attributes"][0]
    first |= {"required": False, "minLength": 1, "tags": []}
    loose["attributes"][2]["attributes"][0]["values"] = ["m", "q"]
    assert len(schema.specialisation_errors(DEFINITION, loose)) == 4
    assert schema.specialisation_errors(DEFINITION, {"attributes": []}) == [f"{p} is missing" for p in ("age", "person.birth", "person.first", "phones", "sex")]


def test_rules_and_config():
    rules = {r.path: r for r in L.resolve_rules(DEFINITION)}
    assert rules["person.first"] == L.Rule("person.first", "string", "name.first", ("trim", "lower", "umlautFold"), ("cologne",), ("phonetic", "prefix3"), 2.0)
    assert rules["person.birth"].weight == 3.0 and rules["person.birth"].tag == "generic.birth" and "year" in rules["person.birth"].blocking
    config = L.resolve_config(DEFINITION)
    assert (config.min_score, config.min_normalized, config.limit, config.auto_link, config.on_match) == (5.0, 0.5, 250, True, "returnExisting")
    assert L.resolve_config({}, DEFINITION).min_score == 5.0 and L.resolve_config(None).min_score == 4.0


def test_phonetic_matches_reach_three_quarters(spark):
    rules = [L.Rule("p.last", tag="name.last", encoders=("cologne",), blocking=("phonetic",), weight=4.0)]
    people = spark.createDataFrame([(1, "Meyer"), (2, "Maier"), (3, None), (4, " "), (5, "Schulz")], "id long, last string")
    index = L.tokens(people, rules, {"p.last": "last"})
    config = L.Config(min_score=1.0)
    found = L.find(index.where("id = 1"), index, config)
    assert [(r.query, r.id, r.score, r.normalized, r.matched_on) for r in found.collect()] == [(1, 2, 3.0, 0.75, ["p.last [name.last, PHONETIC]"])]
    assert L.find(index, index.limit(0), config).count() == 0 and L.find(index, index, L.Config(enabled=False)).count() == 0
    assert L.without_instances(index, spark.createDataFrame([(1,)], "id long")).where("id = 1").count() == 0


def test_protected_candidates_are_all_scored(spark, tmp_path):
    """Records with the query's segment share many bands, but only those with its birth date qualify."""
    spark.range(1, 2201).selectExpr("id c_custkey", "concat('Customer#', id) c_name", "element_at(array('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'), cast(1 + (id div 7) % 5 as int)) c_mktsegment", "id % 7 c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r.query, r.id): r for r in records.pprl_linkage(spark, str(tmp_path)).collect()}
    same_birth = {(q, i) for q in range(20, 2201, 20) for i in range(1, 2201) if i != q and (i - q) % 997 == 0}
    assert same_birth <= set(got) and all(got[k].score >= 3.0 for k in same_birth)
    best = {q: max(r.normalized for (k, _), r in got.items() if k == q) for q, _ in got}
    assert all(r.normalized == best[q] for (q, _), r in got.items() if r.rank == 1)


def test_search_reads_long_and_escaped_documents(spark):
    texts = ['{"a": "' + 'word \\"q\\" ' * 50_000 + 'ra\\u0064iology"}', '{"a": "RADIO"}', '{"ra\\u0064io": 1}', '"a": "ra\\u0064io"', '{"a": "ra\\u0064"}', None]
    rows = spark.createDataFrame([(k, "u", t) for k, t in enumerate(texts)], "id int, instance_uid string, data string").selectExpr("*", "1 project_id", "1 entity_type_id", "false is_deleted", "timestamp'2020-01-01' created_at", "timestamp'2020-01-01' updated_at").repartition(2)
    assert sorted(r.id for r in search.instances(rows, "Radio", most=None).collect()) == [0, 1]
    assert sorted(r.id for r in search.instances(rows, "RA", most=None).collect()) == [0, 1, 4]


@pytest.mark.parametrize("private, least", [(True, 2.0), (True, 0.5), (False, 2.0), (False, 3.5)])
def test_kinds_of_records_are_scored_once(spark, private, least):
    """Scoring by profiles gives what scoring every candidate gives; rare values, nulls and shared tags included."""
    rules = [L.Rule("p.segment", tag="t", encoders=("doubleMetaphone",), blocking=("bloomBands", "phonetic", "prefix4"), weight=1.0), L.Rule("p.birth", kind="date", tag="date.birth", normalizers=(), blocking=("exact",), weight=3.0), L.Rule("p.other", tag="t", blocking=("exact",), weight=0.75)]
    people = spark.range(200).selectExpr("id", "element_at(array('building', 'builder', 'furniture', 'machinery', null), cast(1 + id % 5 as int)) segment", "if(id % 17 = 3, null, date_format(date_add(date'1960-01-01', cast(id % 7 * 31 as int)), 'yyyy-MM-dd')) birth", "element_at(array('furniture', 'other', ' ', null), cast(1 + id % 4 as int)) other")
    config = L.Config(private=private, pprl=L.Pprl("secret", length=128, positions=4), min_score=least, min_normalized=0.3, limit=None)
    index = L.tokens(people, rules, {"p.segment": "segment", "p.birth": "birth", "p.other": "other"}, config).localCheckpoint()
    asked = index.where("id % 3 = 0")
    every = L.scored(L.candidates(asked, index, None), asked, index, config).where(f"score >= {least} and normalized >= 0.3")
    rows = lambda df: sorted((r.query, r.id, round(r.score, 9), round(r.normalized, 9), tuple(r.matched_on)) for r in df.collect())
    by_profile = L.scored_by_profile(asked, index, config)
    assert by_profile is not None and rows(by_profile) == rows(every) != []
    assert L.scored_by_profile(asked.limit(0), index, config) is None


def test_every_record_asks(spark, tmp_path):
    """Protected linkage takes no record out of those that ask: each finds its twin, whatever its number."""
    spark.range(1, 1201).selectExpr("id c_custkey", "concat('Customer#', id) c_name", "element_at(array('AUTOMOBILE', 'BUILDING', 'FURNITURE'), cast(1 + id % 3 as int)) c_mktsegment", "id % 7 c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r.query, r.id): r for r in records.pprl_linkage(spark, str(tmp_path)).collect()}
    twins = {(q, i) for a in range(1, 204) for q, i in ((a, a + 997), (a + 997, a))}
    assert twins <= set(got) and all((i, q) in got and got[i, q].score == r.score for (q, i), r in got.items())


@pytest.mark.parametrize("together, least", [(1000, 2.0), (3, 2.0), (3, 0.5)])
def test_ranks_by_kind_are_those_by_query(spark, together, least):
    """Lists ranked once per kind, cut into groups or not, step over each query's own record."""
    rules = [L.Rule("p.segment", tag="t", blocking=("exact", "prefix4"), weight=1.0), L.Rule("p.birth", kind="date", tag="date.birth", normalizers=(), blocking=("exact",), weight=3.0)]
    people = spark.range(150).selectExpr("id", "element_at(array('building', 'builder', 'furniture', null), cast(1 + id % 4 as int)) segment", "if(id % 17 = 3, null, date_format(date_add(date'1960-01-01', cast(id % 5 * 31 as int)), 'yyyy-MM-dd')) birth")
    config = L.Config(private=True, pprl=L.Pprl("secret", length=128, positions=4), min_score=least, min_normalized=0.3, limit=None)
    index = L.tokens(people, rules, {"p.segment": "segment", "p.birth": "birth"}, config).localCheckpoint()
    for asked in (index, index.where("id % 3 = 0"), index.where("id < 40").withColumn("id", F.col("id") + 30)):
        every = L.scored(L.candidates(asked, index, None), asked, index, config).where(f"score >= {least} and normalized >= 0.3")
        lists = {}
        for r in every.collect():
            lists.setdefault(r.query, []).append((-round(r.normalized, 9), -round(r.score, 9), r.id))
        want = {(q, i, k) for q, v in lists.items() for k, (_, _, i) in enumerate(sorted(v), 1)}
        got = L.scored_by_profile(asked, index, config, together)
        assert {(r.query, r.id, r["rank"]) for r in got.collect()} == want != set()
        assert got.count() == len(want)


@pytest.mark.parametrize("hot", [1, 1000])
def test_hot_blocks_are_salted_without_loss(spark, hot):
    rules = [L.Rule("a", tag="t", blocking=("exact",), weight=1.0)]
    people = spark.range(30).select("id", F.when(F.col("id") < 20, "same").otherwise(F.col("id").cast("string")).alias("v"))
    index = L.tokens(people, rules, {"a": "v"})
    assert L.candidates(index.where("id < 3"), index, None, hot_rows=hot).count() == 3 * 19


def test_instance_creation(spark):
    held = spark.createDataFrame([(1, 1, 1, '{"a": 1, "b": 2}', False), (2, 1, 1, '{"c": 1}', True)], "id int, project_id int, entity_type_id int, data string, is_deleted boolean")
    asks = spark.createDataFrame([(1, 1, 1, '{"b":2,"a":1}'), (2, 1, 1, '{"c":1}'), (3, 1, 1, '{ "c": 1 }'), (4, 1, 1, "x"), (5, 1, 1, None), (6, 2, 1, '{"a":1,"b":2}')], "request int, project_id int, entity_type_id int, data string")
    got = {r.request: (r.status, r.existing) for r in entities.create_instances(asks, held).collect()}
    assert got == {1: ("duplicate", 1), 2: ("created", None), 3: ("duplicate", None), 4: ("rejected", None), 5: ("rejected", None), 6: ("created", None)}


def test_dedup_meets_held_documents_and_earlier_requests(spark, data):
    rows = records.instances(spark, data)
    keyed = lookup.json_equal_key(rows.select("id", "project_id", "entity_type_id", "is_deleted", "data"), "data").collect()
    scope = lambda r: (r.project_id, r.entity_type_id, r.json_key)
    held = {scope(r) for r in keyed if r.json_key is not None and r.id % 2 == 0 and not r.is_deleted}
    asked = [scope(r) for r in keyed if r.json_key is not None]
    new = {k for k in asked if k not in held}
    want = {"created": len(new), "duplicate": len(asked) - len(new), "rejected": len(keyed) - len(asked)}
    assert held and Counter(r.status for r in records.instance_dedup(spark, data).collect()) == {k: n for k, n in want.items() if n}


def test_encoders_see_many_values(spark, data):
    rows = spark.read.parquet(f"{data}/customer.parquet").count()
    stored = records.pprl_stored(spark, data).collect()
    # Names with the same set of n-grams ("...011", "...111") share a filter.
    assert len(stored) == rows and all(r.same for r in stored) and len({r.stored for r in stored}) > rows / 2


def test_algorithms(spark):
    table = spark.createDataFrame([(1, "MD5", 32)], "id int, name string, pseudonymlength int")
    same, new = entities.get_or_create_algorithm(table, {"name": "MD5", "pseudonymlength": 32})
    assert not new and same.count() == 1
    more, new = entities.get_or_create_algorithm(table, {"name": "SHA1", "pseudonymlength": None})
    assert new and more.where("id = 2 and pseudonymlength is null").count() == 1


def test_stored_bytes(spark, data):
    assert lookup.stored_bytes(spark.read.parquet(f"{data}/region.parquet")) > 0
