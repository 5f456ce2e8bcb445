"""Golden values and properties of the functions."""

import hashlib
import hmac
import unicodedata

import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from veilframe.functions import fulltext, hashing, luhn, normalize, pprl, validity
from veilframe.functions.blake3 import blake3_hex
from veilframe.functions.jsondoc import canonical, digest, known, parse, plain
from veilframe.functions.phonetics import cologne, double_metaphone

SALT = "pinch-of-salt-for-tests-0123456789"
LENGTHS = {"MD5": 32, "SHA1": 40, "SHA2": 32, "SHA3": 32, "XXHASH": 16}
LIBRARY = {"MD5": hashlib.md5, "SHA1": hashlib.sha1, "SHA2": hashlib.sha512, "SHA3": hashlib.sha3_512}


def luhn_sum(text, signs, first):
    total = 0
    for k, sign in enumerate(reversed(text)):
        if sign not in signs:
            return None
        v = (first if k % 2 == 0 else 3 - first) * signs.index(sign)
        total += v // len(signs) + v % len(signs)
    return total


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


@pytest.mark.parametrize("name", LENGTHS)
def test_hashes(spark, name):
    text = "90210" + "KIND" + SALT
    value = LIBRARY[name](text.encode()).hexdigest().upper() if name in LIBRARY else xxhash.xxh64(text.encode(), seed=int.from_bytes(hashlib.sha256(SALT.encode()).digest()[:8], "big")).hexdigest()
    value = value[: LENGTHS[name]]
    digit = luhn.MOD16[-luhn_sum(value.upper(), luhn.MOD16, 2) % 16]
    raw = hashing.xxhash(F.lit(text), SALT) if name == "XXHASH" else hashing.HASHES[name](F.lit(text))
    cut = luhn.corrected_length(raw, F.lit(LENGTHS[name]), F.lit("0"))
    none, signs = F.lit(""), luhn.MOD16
    assert one(spark, cut, luhn.compute(cut, none, signs), luhn.valid(F.concat(cut, luhn.compute(cut, none, signs)), none, signs)) == (value, digit, True)


@pytest.mark.parametrize("signs", [luhn.MOD10, luhn.MOD16, luhn.MOD26, luhn.MOD32, luhn.MOD36])
@pytest.mark.parametrize("first", [1, 2])
def test_digit_sums(spark, signs, first):
    import random

    r = random.Random(first)
    texts = ["".join(r.choice(signs) for _ in range(k)) for k in (0, 1, 2, 3, 31, 32, 200)] + ["?", signs[0] + "ä", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("a", F.when(F.col("i") != 2, F.lit(signs)))
    got = {x.i: (x.fixed, x.own) for x in df.select("i", luhn.digit_sum(F.col("t"), signs, first).alias("fixed"), luhn.digit_sum(F.col("t"), F.col("a"), first).alias("own")).collect()}
    want = {i: None if t is None else luhn_sum(t, signs, first) for i, t in enumerate(texts)}
    assert got == {i: (w, None if i == 2 else w) for i, w in want.items()}


def test_hashes_of_null(spark):
    null = F.lit(None).cast("string")
    assert one(spark, *[h(null) for h in hashing.HASHES.values()], hashing.xxhash(null)) == (None,) * 6


@pytest.mark.parametrize(("text", "value"), [("The quick brown fox jumps over the lazy dog", "0b242d361fda71bc"), ("The quick brown fox jumps over the lazy dog.", "44ad33705751ad73"), ("1", "b7b41276360564d4"), ("fewfwewwedwdwwwwwxsdafvdsssss", "0ed74b125c8ae7f1")])
def test_xxhash_without_salt(spark, text, value):
    assert one(spark, hashing.xxhash(F.lit(text))) == (value,)


def test_xxhash_with_salts(spark):
    texts = ["", "ä" * 7, "x" * 100]
    for salt in ("a", "salt" * 9):
        got = one(spark, *[hashing.xxhash(F.lit(t), salt) for t in texts])
        assert got == tuple(f"{xxhash.xxh64_intdigest(t.encode(), hashing.salt_seed(salt)):016x}" for t in texts)


def test_blake3_vectors():
    assert blake3_hex(["", "abc", None]) == ["af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85", None]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 3000, 5000])
def test_blake3_lengths_agree_alone_and_together(size):
    text = "x" * size
    assert blake3_hex([text, text + "y"]) == [blake3_hex([text])[0], blake3_hex([text + "y"])[0]]


@pytest.mark.parametrize(("text", "signs", "digit"), [("0000000000000002", luhn.MOD10, "6"), ("7992739871", luhn.MOD10, "3"), ("PATIENT", luhn.MOD26, "S"), ("A1C2E3", luhn.MOD32, "K"), ("A1B2C3", luhn.MOD36, "R"), ("G1", luhn.MOD16, None), ("", luhn.MOD10, "0")])
def test_luhn(spark, text, signs, digit):
    assert one(spark, luhn.compute(F.lit(text), F.lit(""), signs)) == (digit,)


def test_luhn_prefix_and_validation(spark):
    p, s = F.lit("CU-"), luhn.MOD16
    assert one(spark, luhn.valid(F.lit("XX-12"), p, s), luhn.valid(F.lit("CU-G"), p, s), luhn.compute(F.lit("CU-12"), p, s), luhn.compute(F.lit(" 12 "), F.lit(None).cast("string"), s)) == (False, None, one(spark, luhn.compute(F.lit("12"), F.lit(""), s))[0], one(spark, luhn.compute(F.lit("12"), F.lit(""), s))[0])


def test_alphabets_and_lengths():
    assert luhn.alphabet_of("md5 ") == luhn.HEX and luhn.alphabet_of(None) == luhn.LETTERS and luhn.alphabet_of("random", "AB") == "AB" and luhn.alphabet_of("RANDOM") == luhn.SYMBOLS
    assert luhn.check_alphabet("RANDOM", "ABC") == "AB" and luhn.check_alphabet("RANDOM", legacy=True) == luhn.MOD10
    with pytest.raises(ValueError):
        luhn.check_alphabet("RANDOM_HEX", legacy=True)
    assert luhn.pseudonym_length(10**8, 0.99999998, 26) == 8 and luhn.pseudonym_length(10**9, 0.999999998, 36) == 8
    assert luhn.valid_salt(luhn.generate_salt(12)) and not luhn.valid_salt("short") and not luhn.valid_salt(None)


@pytest.mark.parametrize(("period", "end"), [("1d", "2023-02-01 12:00:00"), ("8 w", "2023-03-28 12:00:00"), ("10hours", "2023-01-31 22:00:00"), ("12 minutes", "2023-01-31 12:12:00"), ("53secs", "2023-01-31 12:00:53"), ("1 MO.", "2023-02-28 12:00:00"), ("-3 mo.", "2022-10-31 12:00:00"), ("+2yrs", "2025-01-31 12:00:00"), ("5m", "2023-01-31 12:05:00"), ("7 ms", "2023-01-31 12:00:00.007000"), ("abc", None), ("", None), ("1 fortnight", None), (None, None), ("9" * 20 + " d", None), ("9000000 y", None)])
def test_periods(spark, period, end):
    got = one(spark, validity.plus(F.expr("timestamp_ntz'2023-01-31 12:00:00'"), F.lit(period).cast("string")))[0]
    assert (str(got) if got else None) == end


@pytest.mark.parametrize(("text", "moment"), [("2025-12-31", "2025-12-31 00:00:00"), ("2025-12-31 12:00", "2025-12-31 12:00:00"), ("2025-12-31T12:00+02:00", "2025-12-31 10:00:00"), ("2025-12-31 12:00:30 Z", "2025-12-31 12:00:30"), ("2025-12-31Z", "2025-12-31 00:00:00"), ("2025-13-31", None), ("x", None), ("", None), (None, None)])
def test_dates(spark, text, moment):
    got = one(spark, validity.parse(F.lit(text).cast("string")))[0]
    assert (str(got) if got else None) == moment


def test_normalisation(spark):
    rules = ["trim", "lower", "collapseWhitespace", "removePunctuation", "umlautFold", "no such rule"]
    assert one(spark, normalize.normalize(F.lit(" \tMüller \n Straße. "), rules), normalize.normalize(F.lit(" ... "), rules), normalize.normalize(F.lit("É ł"), ["asciiFold"]), normalize.iso_date(F.lit("2020-02-30")), normalize.iso_date(F.lit("2020-02-29+01:00")), normalize.prefix_block(F.lit("ab"), 3)) == ("mueller strasse", None, "E ł", None, "2020-02-29", None)


@settings(max_examples=30, deadline=None)
@given(st.text())
def test_ascii_fold_is_decomposition_without_marks(text):
    want = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M")
    import pandas as pd

    assert normalize.ascii_fold.func(pd.Series([text, None]))[0] == want


def test_phonetics():
    for word, c, m in [("Müller", "657", "MLR"), ("Schmidt", "862", "XMT"), ("Smith", "862", "SM0"), ("Meyer", "67", "MR"), ("Straße", "8278", "STRS"), ("Wikipedia", "3412", "AKPT"), ("Breschnew", "17863", "PRXN"), ("Thompson", "26186", "TMPS"), ("Knight", "4642", "NT")]:
        assert (cologne(word), double_metaphone(word)) == (c, m)
    assert cologne("") == "" and double_metaphone("") == ""


def test_phonetics_agree_with_the_codec(spark, data):
    codec = spark.sparkContext._jvm.org.apache.commons.codec.language
    c, m = codec.ColognePhonetic(), codec.DoubleMetaphone()
    words = {w for r in spark.read.parquet(f"{data}/documents.parquet").select("text").dropna().limit(60).collect() for w in r.text.split()[:30]}
    assert all(cologne(w) == c.encode(w) and double_metaphone(w) == (m.encode(w) or "") for w in words)


P = pprl.Pprl("secret")


def reference_hmac(category, value):
    return hmac.new(b"secret", f"{pprl.CONTEXT}|1|1|generic.name|{category}|{value}".encode(), hashlib.sha256).digest()


def test_pprl(spark):
    a, one_, tag = F.lit("anna"), F.lit(1), F.lit("generic.name")
    bits = pprl.bloom_positions(P, one_, one_, tag, a)
    grams, got, none = one(spark, pprl.ngrams(a, 2), bits, pprl.bloom_positions(P, one_, one_, tag, F.lit(None).cast("string")))
    assert grams == ["^a", "an", "nn", "na", "a$"] and none is None
    assert got == sorted({int.from_bytes(reference_hmac("ngram", f"{g}|{i}")[:4], "big", signed=True) % 1024 for g in grams for i in range(10)})
    assert one(spark, pprl.dice(bits, bits), pprl.dice(F.array().cast("array<int>"), F.array().cast("array<int>"))) == (1.0, 0.0)
    stored = spark.createDataFrame([(got,), (None,)], "bits array<int>").withColumn("s", pprl.encode_bits(1024)("bits")).withColumn("back", pprl.decode_bits("s"))
    rows = stored.collect()
    assert len(rows[0].s) == 171 and rows[0].back == got and rows[1].s is None and rows[1].back is None


def test_pprl_signed_positions_for_odd_lengths(spark):
    p = pprl.Pprl("secret", length=1000)
    got = one(spark, pprl.bloom_positions(p, F.lit(1), F.lit(1), F.lit("generic.name"), F.lit("anna")))[0]
    assert got == sorted({int.from_bytes(reference_hmac("ngram", f"{g}|{i}")[:4], "big", signed=True) % 1000 for g in ("^a", "an", "nn", "na", "a$") for i in range(10)})


def test_pprl_needs_a_secret():
    with pytest.raises(ValueError):
        pprl.Pprl("").floored()
    low = pprl.Pprl("s", n=1, length=5, positions=0, band=1).floored()
    assert (low.n, low.length, low.positions, low.band) == (2, 128, 1, 8)


def test_fulltext(spark):
    assert one(spark, F.size(fulltext.trigrams(F.lit("word one"))), fulltext.similarity(F.lit("word"), F.lit("word")), fulltext.similarity(F.lit(""), F.lit("")), fulltext.json_text(F.lit('{"a": "x y", "b": ["z", 1], "c": {"d": "w"}}'))) == (9, 1.0, 0.0, "x y z w")


def test_strict_json():
    assert parse(' {"a": 1}\n') == {"a": 1}
    for bad in (None, "", "[]", "{} {}", '{"a": NaN}', '{"a": 1}}', "null", '{"a":' * 100_000):
        assert parse(bad) is None


def test_plain_form():
    assert plain("  Straße–1. A ") == plain("STRASSE 1a") and plain(" …") == ""
    assert canonical(parse('{"b": [1.0, null, true], "a": "X y"}', True)) == canonical(parse('{"a":"xY.","b":[1.0,null,true]}', True)) != canonical(parse('{"a":"xY.","b":[1,null,true]}', True))
    assert digest(1, 23) != digest(12, 3)


def test_stand_ins():
    assert not any(map(known, (None, "", "  ", "-", "--", "?", "N/A", "k. A.", "nicht bekannt", "Unknown ", "00000", "1900-01-01", "01.01.1900")))
    assert all(map(known, ("x", 0, False, "00001", "1900-01-02", "Na-Na")))


def test_json_strings_are_unescaped(spark):
    texts = ['{"a": "x\\nbreak zeta", "b": ", q", "c": ["say \\"hi\\" there", 5, {"k:": "v:"}], "n\\"m": "\\u00e4\\u0062"}', '{"a": "x"', '"lone"', "[]", None, '{"a": "b\\\\"}', '{"a" : "b" }']
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    assert [r.t for r in df.select(fulltext.json_text(F.col("d")).alias("t")).collect()] == ['x\nbreak zeta , q say "hi" there v: äb', None, "lone", "", None, "b\\", "b"]


def test_long_json_strings_need_no_stack(spark):
    """Strings longer than a thread's stack allows calls, with escapes; the failure ends the virtual machine."""
    text = 'word \\"q\\" \\n' * 100_000
    df = spark.createDataFrame([('{"n:" :  1, "a": "' + text + '", "b": ["z"]}',), ('{"a": "' + text,)], "d string").repartition(2)
    got = df.select(fulltext.json_text(F.col("d")).alias("t")).select(F.length("t").alias("n"), F.array_sort(fulltext.lexemes(F.col("t"))).alias("l")).collect()
    assert sorted(((r.n, r.l) for r in got), key=str) == [(100_000 * 10 + 2, ["q", "word", "z"]), (None, None)]


def test_what_follows_a_json_value_makes_it_none(spark):
    good = ['{"a": "b"}', ' [1] \n', '"]}"', "1", "null", "{}", "[[], {}]"]
    bad = ['"no": "x"', '{"a": 1}}', "1]", "1}", "1, 2", "1, 2] x", '1, "b": 2', '1, "": 2} x', "{} {}", "[1] 2", "", " ", "1,", "'a'", '{"a": 1}, {"b": 2}', "1], [2", "1}, {", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "k int, d string")
    assert [r.ok for r in df.select("k", fulltext.is_json(F.col("d")).alias("ok")).orderBy("k").collect()] == [True] * len(good) + [False] * len(bad)
