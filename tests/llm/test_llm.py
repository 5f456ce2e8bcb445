"""Problems on training data against brute force, exact round trips and hard small cases."""

import random
import unicodedata
from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.oracle import connect, same_rows
from veilframe.functions.jsondoc import canonical, definitions, known, parse, plain, scalars
from veilframe.llm import consensus, queries as Q
from veilframe.llm.consensus import Profile, distance
from veilframe.llm.lookalike import classes, clean_texts, forms, lookalikes
from veilframe.llm.matching import assign, closed, collapse, expand, links, match, membership
from veilframe.llm.packing import Containers, mixture_report, pack, windows
from veilframe.llm.persons import attributes, birth_date, phone_number, split_name
from veilframe.llm.rewritings import rewritings
from veilframe.llm.survivors import cells, survivors
from veilframe.llm.tokens import _pieces, decode, encode, encoding, token_counts

INSTANCE = "id long, project_id int, entity_type_id int, data string"


def instances(spark, data):
    return spark.read.parquet(f"{data}/entity_instance.parquet")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, data, name):
    same_rows(Q.queries()[name](spark, data), connect(data), Q.oracle_sql()[name])


# 1 duplicates hidden by formatting


def brute_rewritings(rows):
    by = defaultdict(list)
    for r in rows:
        document = parse(r.data, True)
        if document is not None:
            by[r.project_id, r.entity_type_id, canonical(document)].append(r.id)
    return sorted((min(v), i) for v in by.values() for i in v if i != min(v))


def test_rewritings_of_the_whole_table(spark, data):
    want = brute_rewritings(instances(spark, data).collect())
    assert sorted(map(tuple, Q.p1_found(spark, data).collect())) == want and want
    copies = Counter(f for f, _ in want)
    assert {r.first_id: r.copies for r in Q.p1_records(spark, data).collect()} == {f: n + 1 for f, n in copies.items()}


WRITINGS = ['{"a": "Straße 1", "b": [1, "x"]}', '{"b":[1,"X."],"a":"STRASSE\\t1"}', '{"a": "stra\\u00dfe\\u00a01", "b": [1, "\\u0078"]}', '\n{"\\u0061": "\\u0053tra\\u00dfe 1", "b": [1, "x"]} ', '{"a": "Straße 1", "b": ["x", 1]}', '{"a": "Straße 1", "b": [1.0, "x"]}', '{"a": "Straße 1", "b": [1, "x"], "c": null}', "{}", "{ }", '{"a": "' + "lang " * 20_000 + '"}', '{"a": "' + "LANG" * 20_000 + '!"}', None, "", "x", "[]", '{"k": "K"}', '{"k": "k"}', '{"k": "K"}', '{"n": "\\\\u00df"}', '{"n": "u00DF"}']


@pytest.mark.parametrize("hot", [1, 2, 10_000])
def test_rewritings(spark, hot):
    rows = [(i, None if i % 2 else 1, 2, w) for i, w in enumerate([w for w in WRITINGS for _ in range(2)] * 3)]
    df = spark.createDataFrame(rows, INSTANCE).withColumn("class", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("key", F.lit(2))
    got = sorted((r.first_id, r.id) for r in rewritings(df, ["project_id", "entity_type_id"], hot_rows=hot).where("id <> first_id").collect())
    assert got == brute_rewritings(df.collect())


def test_a_full_filter_changes_nothing(spark, data):
    rows = instances(spark, data)
    got = rewritings(rows, Q.SCOPE, filter_bits=64).where("id <> first_id").select("first_id", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, Q.p1_found(spark, data).collect()))


def test_rewritings_of_nothing(spark):
    assert rewritings(spark.createDataFrame([], INSTANCE), ["project_id"]).count() == 0


# 2 survivors


def brute_survivors(spark, data):
    groups = definitions([(r.id, r.type_definition) for r in spark.read.parquet(f"{data}/entity_type.parquet").collect()])
    by = defaultdict(list)
    for r in instances(spark, data).withColumn("u", F.unix_micros("updated_at")).collect():
        document = parse(r.data)
        number = document and document.get(Q.RECORD_NUMBERS[r.entity_type_id])
        if isinstance(number, str) and plain(number):
            by[r.project_id, r.entity_type_id, plain(number)].append((r.id, r.is_deleted, r.u, document))
    out = []
    for (_, kind, _), rows in by.items():
        if len(rows) > 1:
            best = {}
            for i, gone, u, document in rows:
                for field, value in [] if gone else scalars(document, groups[kind]):
                    if field != Q.RECORD_NUMBERS[kind] and known(value):
                        best[field] = max(best.get(field, (-(2**70), 0)), (-(2**70) + 1 if u is None else u, i))
            out += [(min(r[0] for r in rows), f, i) for f, (_, i) in best.items()]
    return sorted(out)


def test_survivors_of_the_whole_table(spark, data):
    want = brute_survivors(spark, data)
    assert sorted(map(tuple, Q.p2_found(spark, data).collect())) == want and want
    assert Q.p2_records(spark, data).count() == len({f for f, _, _ in want})


def brute_path(skip, insert, sub):
    """The least cost of every path."""
    best = None
    stack = [((), 0, 0, 0)]
    while stack:
        moves, i, j, cost = stack.pop()
        if i == len(insert) and j == len(skip):
            best = cost if best is None else min(best, cost)
            continue
        if j < len(skip):
            stack.append(((*moves, 0), i, j + 1, cost + skip[j]))
        if i < len(insert):
            stack.append(((*moves, 2), i + 1, j, cost + insert[i]))
            if j < len(skip):
                stack.append(((*moves, 1), i + 1, j + 1, cost + sub(i)[j]))
    return best


def cost_of(moves, skip, insert, sub):
    i = j = total = 0
    for m in moves:
        total += skip[j] if m == 0 else sub(i)[j] if m == 1 else insert[i]
        i, j = i + (m != 0), j + (m != 2)
    assert (i, j) == (len(insert), len(skip))
    return total


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=5), st.lists(st.integers(0, 4), max_size=5), st.randoms())
def test_paths_are_the_best_and_the_same_by_every_way(skip, insert, r):
    pairs = [[r.randrange(6) for _ in skip] for _ in insert]
    small = consensus.path(skip, insert, lambda i: pairs[i])
    arrays = [np.array(p, np.int64) for p in pairs]
    assert cost_of(small, skip, insert, lambda i: pairs[i]) == brute_path(skip, insert, lambda i: pairs[i])
    few, cells = consensus.FEW, consensus.CELLS
    try:
        consensus.FEW = 0
        whole = consensus.path(skip, insert, lambda i: arrays[i])
        consensus.CELLS = 1
        halved = consensus.path(skip, insert, lambda i: arrays[i])
    finally:
        consensus.FEW, consensus.CELLS = few, cells
    assert small == whole == halved


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_two_values_align_at_their_edit_distance(a, b):
    profile = Profile.of(a, (1, (1, 1)))
    profile.merge(Profile.of(b, (1, (2, 2))))
    columns = profile.columns
    assert all(sum(v for v, _ in c.values()) == 2 for c in columns)
    assert sum(len(c) > 1 for c in columns) == brute_distance(a, b) == distance(a, b)
    assert profile.consensus(True) == b


def test_long_values_align_as_well_as_short_ones():
    r = random.Random(4)
    for _ in range(12):
        a, b = ([r.choice("abcd") for _ in range(n)] for n in (70, r.randrange(60, 300)))
        profile = Profile.of(a, (1, (1, 1)))
        profile.merge(Profile.of(b, (1, (2, 2))))
        assert sum(len(c) > 1 for c in profile.columns) == brute_distance(a, b) == distance(a, b)


def test_tokens_inserted_by_several_values_meet():
    profile = Profile()
    for k, text in enumerate(["a b", "a x y b", "a y b", "a x b"]):
        profile.merge(Profile.of(text.split(), (1, (k, k))))
    assert [c.get("x", (0,))[0] for c in profile.columns] == [0, 2, 0, 0] and [c.get("y", (0,))[0] for c in profile.columns] == [0, 0, 2, 0]


CELLS = "first_id long, field string, value string, updated long, id long"


@pytest.mark.parametrize(("hot", "leaf"), [(1, 256), (10_000, 256), (1, 2), (10_000, 3)])
def test_majority_takes_the_value_closest_to_the_consensus(spark, hot, leaf):
    rows = [(1, "street", v, u, i) for i, (v, u) in enumerate([("Am Alten Markt 5", 9), ("Am Alten Markt 6", 1), ("Am Alten Platz 5", 2), ("Am Markt 5", 3), ("Am Alten Markt 5", None)])]
    rows += [(2, "x", "only", None, 7), (3, "y", "a", 5, 8), (3, "y", "b", 5, 9), (4, "z", "a b", 1, 1), (4, "z", "a b c", 1, 2), (4, "z", "a b d", 1, 3)]
    df = spark.createDataFrame(rows, CELLS).withColumn("leaf", F.lit("clash"))
    got = {(r.first_id, r.field): (r.value, r.value_id) for r in survivors(df, "majority", hot, leaf).collect()}
    assert got == {(1, "street"): ("Am Alten Markt 5", 0), (2, "x"): ("only", 7), (3, "y"): ("b", 9), (4, "z"): ("a b d", 3)}
    latest = {(r.first_id, r.field): r.value_id for r in survivors(df, "recency", hot, leaf).collect()}
    assert latest == {(1, "street"): 0, (2, "x"): 7, (3, "y"): 9, (4, "z"): 3}
    with pytest.raises(KeyError):
        survivors(df, "else")


@pytest.mark.parametrize("leaf", [4, 1000])
def test_one_cell_with_very_many_values(spark, leaf):
    r = random.Random(6)
    rows = [(1, "f", " ".join(t for t in "the quick brown fox jumps".split() if r.random() < 0.9) + f" {i % 150}", i % 40, i) for i in range(400)]
    got = survivors(spark.createDataFrame(rows, CELLS), "majority", 10, leaf).first()
    assert got.value.startswith("the quick brown fox jumps ")
    assert survivors(spark.createDataFrame(rows, CELLS), "recency", 10, leaf).first().value_id == 399


def brute_consensus(found):
    """Value after value by the profile's own definition, costs of every column by counting pairs; small cells only."""
    by = defaultdict(lambda: defaultdict(list))
    for x in found:
        by[x.first_id, x.field][x.value].append((-(2**63) if x.updated is None else x.updated, x.id))
    out = {}
    for cell, values in by.items():
        ranked = sorted(values, key=lambda v: (-len(values[v]), *(-k for k in max(values[v]))))
        rows = []  # one aligned row (tokens and gaps) per table row
        for v in ranked:
            tokens, n = v.split(), len(values[v])
            width = len(rows[0][0]) if rows else 0
            paired = lambda t, j: sum(row[j] != t for row, _ in rows)  # noqa: B023, E731
            inf = {}

            def cost(i, j):
                if (i, j) not in inf:
                    ways = [0] if i == j == 0 else []
                    if j:
                        ways.append(cost(i, j - 1) + n * paired("", j - 1))
                    if i and j:
                        ways.append(cost(i - 1, j - 1) + n * paired(tokens[i - 1], j - 1))
                    if i:
                        ways.append(cost(i - 1, j) + n * len(rows))
                    inf[i, j] = min(ways)
                return inf[i, j]

            i, j, new = len(tokens), width, []
            while i or j:
                if j and cost(i, j) == cost(i, j - 1) + n * paired("", j - 1):
                    new.append((j - 1, ""))
                    j -= 1
                elif i and j and cost(i, j) == cost(i - 1, j - 1) + n * paired(tokens[i - 1], j - 1):
                    new.append((j - 1, tokens[i - 1]))
                    i, j = i - 1, j - 1
                else:
                    new.append((None, tokens[i - 1]))
                    i -= 1
            new.reverse()
            rows = [([row[j] if j is not None else "" for j, _ in new], rank) for row, rank in rows] + [([t for _, t in new], rank) for rank in values[v]]
        winners = []
        for j in range(len(rows[0][0])):
            votes = defaultdict(list)
            for row, rank in rows:
                votes[row[j]].append(rank)
            winners.append(max(votes, key=lambda t: (len(votes[t]), max(votes[t]), t)))
        text = [t for t in winners if t]
        best = max(values, key=lambda v: (-brute_distance(v.split(), text), max(values[v])))
        out[cell] = (best, max(values[best])[1])
    return out


def test_majority_of_the_whole_table(spark, data):
    found = cells(instances(spark, data), spark.read.parquet(f"{data}/entity_type.parquet"), Q.RECORD_NUMBERS)
    want = brute_consensus(found.collect())
    assert {(x.first_id, x.field): (x.value, x.value_id) for x in Q.p2_consensus(spark, data).collect()} == want and want


def test_cells_of_nothing(spark, data):
    none = instances(spark, data).limit(0)
    assert survivors(cells(none, spark.read.parquet(f"{data}/entity_type.parquet"), Q.RECORD_NUMBERS)).count() == 0


# 5 matching


def test_person_attributes():
    a = attributes(202, {"donorNo": "BD/1", "name": "Müller-Lüdenscheidt, Änne Ida", "dob": "01.02.1950 ", "gender": "W.", "address": "Große Straße 5a, 12345 Ort", "tel": "+49 951 123456", "mail": "A.M@x.example"})
    b = attributes(201, {"mrn": "R1", "person": {"first": "ÄNNE  IDA", "last": "mueller luedenscheidt", "birth": "1950/02/01", "sex": "f"}, "contact": {"street": "grosse Str. 5a", "zip": " 12345", "phone": "0951/123456", "email": "am@x.example"}})
    assert {k: v for k, v in a.items() if k != "number"} == {k: v for k, v in b.items() if k != "number"}
    assert attributes(203, {"givenName": None, "birthDate": "1900/01/01", "phone": "?", "postcode": {}}) == dict.fromkeys(["first", "last", "birth", "sex", "street", "zip", "phone", "email", "number"])
    assert birth_date("19500201") == birth_date("01021950") == birth_date("1950-2-1") == "19500201" and birth_date("1950") is None
    assert phone_number("0951 / 12-34") == "095112" + "34" and phone_number("12") is None
    assert split_name("Kai de Bach") == ("kai", "de bach") and split_name("Bach") == ("bach", "")


PERSON = "id long, project_id int, updated long, record string, first string, last string, birth string, sex string, street string, zip string, phone string, email string"


def people(spark):
    base = ("anna", "bergmann", "19500102", "f", "weg1", "12345", "0123456", None)
    rows = [
        (1, 1, 0, "a1", *base), (2, 1, 1, "a1", *base), (3, 2, 0, "b1", "bergmann", "anna", *base[2:]), (4, 3, 0, "c1", "anna", "bergmnan", "19500103", "f", None, "12345", "0123456", None),
        (5, 2, 0, "twin", "berta", "bergmann", *base[2:]), (6, 3, 0, "same name", "anna", "bergmann", "19710809", "f", "ring2", "54321", "0999999", None),
        (7, 2, 0, "empty", *[None] * 8), (8, 3, 0, "short", "a", "bergmann", None, *base[3:]), (9, 1, 0, "x1", "tobi", "kurz", "19610101", "m", None, None, None, "t@k"), (10, 2, 0, "x2", "tobias", "lang", None, "m", None, None, None, "t@k"),
    ]
    return spark.createDataFrame(rows, PERSON).withColumn("record", F.encode("record", "utf-8"))


@pytest.mark.parametrize(("window", "stretch", "hot"), [(6, 4096, 10_000), (9, 10, 1)])
def test_matching(spark, window, stretch, hot):
    rows = people(spark)
    found = expand(match(rows, window=window, stretch=stretch), rows, hot).collect()
    pairs = {(r.id_a, r.id_b) for r in found}
    # the short name of the third project loses against the full one: one partner per project
    assert pairs == {(1, 3), (2, 3), (1, 4), (2, 4), (3, 4)} | ({(9, 10)} & pairs)
    assert all(0 < r.confidence <= 1 for r in found)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_membership_counts_the_pairs(spark, hot):
    rows = people(spark)
    matched = match(rows)
    pairs = [(r.id_a, r.id_b) for r in expand(matched, rows, hot).collect()]
    assert len(pairs) == len(set(pairs))
    partners = defaultdict(set)
    for a, b in pairs:
        partners[a].add(b)
        partners[b].add(a)
    got = {r.id: (r.person, r.links) for r in membership(matched, rows, hot).collect()}
    assert {i: n for i, (_, n) in got.items()} == {i: len(some) for i, some in partners.items()} and got[1][0] == got[2][0] == got[3][0] == got[4][0] == 1


def test_three_want_two_that_others_leave(spark):
    """Weights as in a crowded household: the third record must get the partner that is left."""
    edges = [(f"x{i}", f"y{j}", w) for i in (1, 2, 3) for j, w in ((1, 20_000), (2, 20_000), (3, 12_000))]
    df = spark.createDataFrame(edges, "x string, y string, weight long").select(F.encode("x", "utf-8").alias("x"), F.encode("y", "utf-8").alias("y"), F.lit(1).alias("px"), F.lit(2).alias("py"), "weight")
    got = assign(df).collect()
    assert len(got) == 3 and sum(e.weight for e in got) == 52_000


def test_matching_of_nothing(spark):
    rows = people(spark).limit(0)
    assert expand(match(rows), rows).count() == 0


def test_pairs_across_partitions_are_found(spark):
    """Sliding over many small partitions finds what one partition finds."""
    r = random.Random(3)
    rows = []
    for i in range(120):
        name, birth = (r.choice(["anna", "bert", "cora"]), r.choice(["kurz", "lang"])), f"19{r.randrange(50, 60)}0{r.randrange(1, 9)}11"
        rows += [(2 * i + k, 1 + k, 0, f"{i}-{k}", *name, birth, "f", None, "12345", f"0{r.randrange(60):06d}", None) for k in range(2)]
    df = collapse(spark.createDataFrame(rows, PERSON).withColumn("record", F.encode("record", "utf-8")))
    few = {tuple(x) for x in links(df, window=4, stretch=16).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        many = {tuple(x) for x in links(df, window=4, stretch=16).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert few == many and few


def test_assignment_maximises_the_total(spark):
    def best(edges):
        if not edges:
            return 0
        (x, y, w), rest = edges[0], edges[1:]
        return max(best(rest), w + best([e for e in rest if e[0] != x and e[1] != y]))

    r = random.Random(2)
    edges = []
    for part in range(12):
        edges += [(f"{part}x{i}", f"{part}y{j}", r.randrange(9000, 20000)) for i in range(3) for j in range(3) if r.random() < 0.7]
    df = spark.createDataFrame(edges, "x string, y string, weight long").select(F.encode("x", "utf-8").alias("x"), F.encode("y", "utf-8").alias("y"), F.lit(1).alias("px"), F.lit(2).alias("py"), "weight")
    got = assign(df).collect()
    assert len({bytes(e.x) for e in got}) == len({bytes(e.y) for e in got}) == len(got)
    want = sum(best([e for e in edges if e[0].startswith(f"{p}x")]) for p in range(12))
    assert want - len(got) * 2 <= sum(e.weight for e in got) <= want


def test_assignment_settles_ties(spark):
    """Three records compete for two partners at equal weight; the one with another link must get it."""
    edges = [(f"x{i}", f"y{j}", 15000) for i in (1, 2, 3) for j in (1, 2)] + [("x2", "y3", 9500)]
    edges += [(f"c{k}", f"d{k + s}", 12000) for k in range(40) for s in (0, 1)]  # one long chain
    df = spark.createDataFrame(edges, "x string, y string, weight long").select(F.encode("x", "utf-8").alias("x"), F.encode("y", "utf-8").alias("y"), F.lit(1).alias("px"), F.lit(2).alias("py"), "weight")
    got = {bytes(e.x).decode(): bytes(e.y).decode() for e in assign(df).collect()}
    assert got["x2"] == "y3" and {got["x1"], got["x3"]} == {"y1", "y2"} and len(got) == len(set(got.values())) == 43
    assert assign(df.limit(0)).count() == 0


def test_implied_pairs(spark):
    rows = [("a", 1, "b", 2, 15000), ("b", 2, "c", 3, 12000), ("c", 3, "d", 4, 11000), ("e", 1, "f", 2, 9000), ("g", 2, "h", 3, 9000)]
    df = spark.createDataFrame(rows, "x string, px int, y string, py int, weight long").select(F.encode("x", "utf-8").alias("x"), "px", F.encode("y", "utf-8").alias("y"), "py", "weight")
    got = {(bytes(r.x).decode() + bytes(r.y).decode()): r.weight for r in closed(df).collect()}
    assert got == {"ab": 15000, "bc": 12000, "cd": 11000, "ac": 12000, "bd": 11000, "ad": 11000, "ef": 9000, "gh": 9000}


# 8 encoding


def test_encoding_equals_the_library(spark, data):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    library.encode_special_tokens = True
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    want = {i: e.ids for i, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False))}
    assert {r.doc_id: list(r.ids) for r in Q.p8_ids(spark, data).collect()} == want


HARD = ["", None, "a", " ", "x" * 5000, " " * 3000 + "y", "\n\n" * 700 + "z", "it's we'll they've " * 90, "<|endoftext|>" * 60, "äöü " * 300, "字" * 900, "1234567890" * 200, "'" * 900, "a b c " * 200, "👩‍🔬" * 200, "don't\n\n\n  \t x" * 120]


def test_chunks_resynchronise(spark):
    r = random.Random(8)
    texts = HARD + ["".join(r.choice(["a", "bc ", " ", "\n", "'ll", "9", "é", "...", "'s ", "  "]) for _ in range(1500)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("chunk", F.lit("clash")).repartition(4)
    enc = encoding("byte_bpe_50k")
    want = {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    for chunk, overlap in ((64, 16), (200, 60), (1 << 20, 1024)):
        got = encode(docs, chunk=chunk, overlap=overlap)
        assert {x.doc_id: list(x.ids) for x in got.collect()} == want
    assert {x.doc_id: x.text for x in decode(got).collect()} == {i: t or "" for i, t in enumerate(texts)}
    for chunk, overlap in ((64, 16), (1 << 20, 1024)):
        assert {x.doc_id: x.tokens for x in token_counts(docs, ["doc_id", "chunk"], chunk=chunk, overlap=overlap).collect()} == {i: len(w) for i, w in want.items()}
    # only the chunks around a long word stay together
    word = spark.createDataFrame([(1, "ab cd " * 40 + "x" * 300 + " ef gh" * 40)], "doc_id long, text string")
    sizes = sorted(len(r.text) for r in _pieces(word, 64, 16).collect())
    assert len(sizes) > 4 and 300 <= sizes[-1] < 500
    with pytest.raises(ValueError):
        encode(docs, chunk=10, overlap=10)


def test_encoding_of_nothing(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 9 packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10)))
def test_containers_never_overflow(sizes):
    c, room = Containers(10), Counter()
    for s in sizes:
        room[c.put(s)] += s
    assert all(v <= 10 for v in room.values())


@pytest.mark.parametrize("part_tokens", [2_000, 10**9])
def test_packing(spark, part_tokens):
    r = random.Random(9)
    sizes = [(i, r.choice(["big", "big", "big", "small", None]), r.choice([0, None, 1, 50, 99, 100, 101, 250, 300, r.randrange(1, 80)])) for i in range(600)]
    df = spark.createDataFrame(sizes, "doc_id long, source string, tokens long").withColumn("part", F.lit("clash"))
    kinds = spark.createDataFrame([(1, 100), (2, 1000), (3, None), (4, 0)], "container_id int, capacity_tokens int")
    rows = pack(df, kinds, part_tokens=part_tokens).collect()
    for kind, capacity in ((1, 100), (2, 1000)):
        held, got, pieces = Counter(), Counter(), defaultdict(list)
        for x in rows:
            if x.container_id == kind:
                held[x.container] += x.tokens
                got[x.doc_id] += x.tokens
                pieces[x.doc_id].append(x.piece)
        assert got == Counter({i: s or 0 for i, _, s in sizes}) and len(got) == 600 and max(held.values()) <= capacity
        assert all(sorted(p) == list(range(len(p))) for p in pieces.values())
        assert all((s or 0) > capacity for i, _, s in sizes if len(pieces[i]) > 1)
        if part_tokens > 10**6:
            assert sum(held.values()) / (len(held) * capacity) > 0.97


def test_windows_follow_the_mixture():
    queues = {"a": deque((i, 10) for i in range(900)), "b": deque((i, 10) for i in range(100))}
    drawn = list(windows(queues, {"a": 0.9, "b": 0.1}, {"a": 0.0, "b": 0.0}, 1000))
    assert sum(map(len, drawn)) == 1000 and all(len(w) == 100 and sum(x[2] == "b" for x in w) == 10 for w in drawn)


def test_deficits_never_exceed_half_a_document():
    r = random.Random(7)
    sizes = {s: [r.randrange(1, 90) for _ in range(400)] for s in "abc"}
    target, taken, total = {"a": 6.0, "b": 3.0, "c": 1.0}, Counter(), 0
    for w in windows({s: deque(enumerate(v)) for s, v in sizes.items()}, target, dict.fromkeys("abc", 0.0), 500):
        for _, size, s in w:
            taken[s] += size
            total += size
        if total > 9000:  # before the first queue is empty
            break
        assert all(abs(taken[s] - total * target[s] / 10) <= 90 for s in "abc")
    assert total > 9000


def test_targets_and_the_report(spark):
    rows = [(i, "abn"[i % 3] if i % 3 < 2 else None, 10) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    kinds, targets = spark.createDataFrame([(1, 100)], "container_id int, capacity_tokens int"), spark.createDataFrame([("a", 3.0), ("b", 1.0), ("nowhere", 9.0)], "source string, share double")
    packed = pack(df, kinds, targets)
    assert packed.count() == 600 and packed.where("source is null").count() == 200
    report = sorted((x.window, x.source or "", x.tokens, x.target, round(x.deviation, 6)) for x in mixture_report(packed, targets).collect())
    assert report[:2] == [(0, "a", 300, 0.75, 0.0), (0, "b", 100, 0.25, 0.0)] and {s for _, s, *_ in report} == {"a", "b", ""}
    even = mixture_report(pack(df, kinds)).collect()
    assert max(abs(x.deviation) for x in even) < 0.05


def test_mixture_of_the_whole_table(spark, data):
    """No window is more than a document of the source away from its target, as long as every source has some left."""
    rows = Q.p9_windows(spark, data).collect()
    assert sum(x.tokens for x in rows if x.container_id == 3) >= sum(x.tokens for x in token_counts(spark.read.parquet(f"{data}/documents.parquet"), ["doc_id"]).collect())
    assert all(abs(x.share - x.target - x.deviation) < 1e-9 for x in rows)


def test_packing_of_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id long, source string, tokens long"), spark.createDataFrame([(1, 10)], "container_id int, capacity_tokens int")).count() == 0


# 10 look-alikes


#: Look-alikes by their names in Unicode: (alphabet, letters as their Latin look-alikes, names of the letters).
NAMED = [
    ("CYRILLIC CAPITAL LETTER", "ABEIKMHOPCTXSJQW", "A VE IE BYELORUSSIAN-UKRAINIAN_I KA EM EN O ER ES TE HA DZE JE QA WE"),
    ("CYRILLIC SMALL LETTER", "aeopcyxisjqwh", "A IE O ER ES U HA BYELORUSSIAN-UKRAINIAN_I DZE JE QA WE SHHA"),
    ("GREEK CAPITAL LETTER", "ABEZHIKMNOPTYX", "ALPHA BETA EPSILON ZETA ETA IOTA KAPPA MU NU OMICRON RHO TAU UPSILON CHI"),
    ("GREEK SMALL LETTER", "aivopu", "ALPHA IOTA NU OMICRON RHO UPSILON"),
    ("ARMENIAN SMALL LETTER", "ohn", "OH HO VO"),
]
LIKE = {unicodedata.lookup(f"{script} {name.replace('_', ' ')}"): latin for script, letters, names in NAMED for latin, name in zip(letters, names.split())} | {"μ": "µ"}


def brute_form(text):
    hidden = {0xAD, 0x34F, 0x61C, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF}
    text = "".join(c for c in text if ord(c) not in hidden)
    text = "".join(unicodedata.normalize("NFKC", c) if 0xFF01 <= ord(c) <= 0xFFEE else " " if unicodedata.category(c) == "Zs" else c for c in text)
    signs = []
    for c in unicodedata.normalize("NFC", text):
        base, *marks = unicodedata.normalize("NFD", c)
        latin = unicodedata.normalize("NFC", LIKE.get(base, base) + "".join(marks))
        signs.append(latin if len(latin) == 1 else c)
    return unicodedata.normalize("NFC", "".join(signs))


TEXTS = ["Café résumé", "Café résumé", "Ｃａｆé résumé", "Саfé résumé", "Ca​f­é résumé", "Cafe resume", "café résumé", "Cafе́ résumé", "10²", "102", "10²", "a\tb", "a b", "a b", "a\nb", "K1", "K1", "К1", "", " ​ ", None, "ї", "ï", "ї", "5 µg", "5 μg", "x" * 70_000, "х" * 70_000]


def brute_lookalikes(texts):
    out = set()
    for i, a in enumerate(texts):
        for j in range(i):
            b = texts[j]
            if a is not None and b is not None and a != b and brute_form(a) == brute_form(b) and brute_form(a).strip():
                out.add((j, i))
    return out


@pytest.mark.parametrize("hot", [1, 4, 10_000])
def test_lookalikes(spark, hot):
    texts = TEXTS + TEXTS[:6] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("form", F.lit("clash")).withColumn("n", F.lit(1))
    got = [tuple(r) for r in lookalikes(docs, hot_rows=hot).collect()]
    compact = {r.doc_id: (r.text_id, r.class_id, r.links) for r in classes(docs, hot_rows=hot).collect()}
    pairs = brute_lookalikes(texts)
    partners = {i: {a + b - i for a, b in pairs if i in (a, b)} for i in {i for p in pairs for i in p}}
    assert compact == {i: (texts.index(texts[i]), min({i, *some} | {j for j in partners if texts[j] == texts[i]}), len(some)) for i, some in partners.items()}
    assert len(got) == len(set(got)) and set(got) == brute_lookalikes(texts)
    assert {r.doc_id: r.form for r in forms(docs).collect()} == {i: None if t is None else brute_form(t) for i, t in enumerate(texts)}


def test_clean_texts_keep_their_alphabet(spark):
    own = ["Ваше життя та їжа у Києві, Her Majesty said: а о і", "Νέα πόλη είναι ωραία ένα", "Café 10² ａ".replace("ａ", "a"), "", None, "ո Հայաստան օ", "жуки і дім, ВАСЕ"]
    odd = ["Bаше життя тa їжа у Києві, Неr Majеsty said: a o i", "Nέα πόλη είναι ωρaίa ένα", "Ｃаfé\u200b 10²\u00a0ａ", "", None, "n Հայաստան o", "жуки i дім, BACE"]
    docs = spark.createDataFrame(list(enumerate(own + odd)), "doc_id long, text string")
    got = {r.doc_id: (r.form, r.clean) for r in clean_texts(docs).collect()}
    assert [got[k][1] for k in range(len(own))] == own and all(got[k] == got[k + len(own)] for k in range(len(own)))


def test_lookalikes_of_the_whole_table(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    by = defaultdict(list)
    for i, t in texts.items():
        if t is not None and brute_form(t).strip():
            by[brute_form(t)].append(i)
    want = {(min(a, b), max(a, b)) for some in by.values() for a in some for b in some if texts[a] != texts[b]}
    assert {tuple(r) for r in Q.p10_found(spark, data).collect()} == want


def test_lookalikes_of_nothing(spark):
    assert lookalikes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
