"""One form for texts that look the same, computed by DuckDB inside Arrow partitions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilframe.plans.durable import durable
from veilframe.plans.skew import HOT_ROWS, lookup

#: Characters without a sign of their own (soft hyphen, joiners, marks of direction, variation selectors,
#: tags, control characters other than tab and line breaks), as a class of a regular expression.
INVISIBLE = (
    r"[\x{0}-\x{8}\x{e}-\x{1f}\x{7f}-\x{84}\x{86}-\x{9f}\x{ad}\x{34f}\x{61c}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}"
    r"\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}\x{1d173}-\x{1d17a}\x{e0000}-\x{e0fff}]"
)
#: Kinds of blank, each of which becomes one ordinary blank.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Letters and the Latin letter that looks like them, by alphabet.
LETTERS = {
    "Cyrillic": {
        "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
        "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    },
    "Greek": {
        "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
        "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "μ": "µ",
    },
    "Armenian": {"Լ": "L", "Ս": "U", "Տ": "S", "Օ": "O", "ա": "ɯ", "գ": "q", "զ": "q", "հ": "h", "յ": "j", "ո": "n", "ս": "u", "ց": "g", "օ": "o"},
}
#: Letters above that few languages use; no text is written with them that has Latin letters in their place.
RARE = set("ЅԚԜӀѕԁһԛԝϹϲϳ")
#: Where the letters of these alphabets lie, those with accents included.
_RANGES = [(0x370, 0x400), (0x400, 0x530), (0x531, 0x590), (0x1F00, 0x2000)]


def look_alikes() -> dict[str, str]:
    """The letters above and, by Unicode's own decompositions, all of them with accents, as far as the Latin letter with
    the same accents is one sign."""
    table = {letter: latin for some in LETTERS.values() for letter, latin in some.items()}
    for c in map(chr, (c for low, high in _RANGES for c in range(low, high))):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base in table and len(latin := unicodedata.normalize("NFC", table[base] + "".join(marks))) == 1:
            table[c] = latin
    return table


def widths() -> tuple[str, str]:
    """Full-width and half-width signs and the usual signs they stand for, by Unicode's compatibility mapping."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xFF01, 0xFFEF)]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1 and b != "ᅠ"]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def form_sql(column: str = "text") -> str:
    """The DuckDB expression of the form; composing again after the letters are mapped joins their accents."""
    wide, usual = widths()
    similar = look_alikes()
    text = f"regexp_replace({column}, {_quoted(INVISIBLE)}, '', 'g')"
    text = f"nfc_normalize(translate({text}, {_quoted(wide + BLANKS)}, {_quoted(usual + ' ' * len(BLANKS))}))"
    return f"nfc_normalize(translate({text}, {_quoted(''.join(similar))}, {_quoted(''.join(similar.values()))}))"


def _class(letters: Iterable[str]) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(letters)) + "]"


def _scripts() -> dict[str, tuple[str, dict[str, str]]]:
    """By alphabet: the pattern of its letters and the way back from the Latin look-alikes to them."""
    every = [(letter, latin) for letter, latin in look_alikes().items() if _base(letter) not in RARE]
    # of two letters with one look-alike the first listed is written
    return {name: (f"\\p{{{name}}}", {latin: letter for letter, latin in reversed(every) if _base(letter) in table}) for name, table in LETTERS.items()}


def _own_latin(text: str) -> str:
    """The Latin letters of a text that look like no letter of another alphabet."""
    shared = {latin for _, back in _scripts().values() for latin in back}
    return f"regexp_replace(regexp_replace({text}, '[^\\p{{Latin}}]', '', 'g'), {_quoted(_class(shared))}, '', 'g')"


def most_sql(form: str = "form") -> str:
    """The DuckDB expression of the alphabet that most of the letters belong to which look like no other's."""
    count = {name: f"length(regexp_replace({form}, '[^{pattern}]', '', 'g'))" for name, (pattern, _) in _scripts().items()}
    others = lambda n: ", ".join([f"length({_own_latin(form)})", *(count[m] for m in count if m != n)])
    return "case " + " ".join(f"when {count[n]} > greatest({others(n)}) then '{n}'" for n in count) + " else 'Latin' end"


def clean_sql(form: str = "form") -> str:
    """The DuckDB expression of a readable text out of a form (and ``m``, see ``most_sql``): letters go back to their own
    alphabet, word by word.

    A word with letters that only its alphabet has is written in it; a word of look-alikes alone follows the text; a
    word with letters of several alphabets stays as it is. All this rests on the form, so texts that look alike have
    one clean text.
    """
    scripts = _scripts()
    has = {name: f"regexp_matches(w, '{pattern}')" for name, (pattern, _) in scripts.items()} | {"Latin": f"{_own_latin('w')} <> ''"}
    several = "(" + " + ".join(f"({test})::int" for test in has.values()) + ") > 1"
    back = {name: f"translate(w, {_quoted(''.join(letters))}, {_quoted(''.join(letters.values()))})" for name, (_, letters) in scripts.items()}
    word = f"case when {several} then w " + " ".join(f"when {has[n]} then {back[n]}" for n in scripts) + f" when {has['Latin']} then w " + " ".join(f"when m = '{n}' then {back[n]}" for n in scripts) + " else w end"
    words = f"regexp_extract_all({form}, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+')"
    return f"nfc_normalize(coalesce(array_to_string(list_transform({words}, lambda w: {word}), ''), {form}))"


def _base(letter: str) -> str:
    return unicodedata.normalize("NFD", letter)[0]


def _duckdb(select: str, schema: pa.Schema):
    """An Arrow partition function that runs one SQL statement over each batch (named ``docs``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        connection = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})
        try:
            for batch in batches:
                connection.register("docs", pa.Table.from_batches([batch]))
                result = connection.sql(select).to_arrow_table().cast(schema)
                connection.unregister("docs")
                yield from result.to_batches()
        finally:
            connection.close()

    return run


def forms(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``form`` of every document: equal for texts that look equal, different for others.

    Width, encoding of accents, invisible characters, kinds of blank (one for one) and the alphabet of look-alike
    letters don't show; letter case, accents, raised digits, tabs, line breaks and all other signs do. A null text
    has a null form, an empty one an empty form.
    """
    sql = f"select doc_id, {form_sql()} as form from docs"
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string())])
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_duckdb(sql, schema), "doc_id bigint, form string")


def _keys(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """128-bit keys of form and text of each document with a visible sign."""
    sql = f"with f as (select doc_id, text, {form_sql()} as form from docs) select doc_id, md5(form) as form, md5(text) as own from f where regexp_matches(form, '[^\\s\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("own", pa.string())])
    keys = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null").mapInArrow(_duckdb(sql, schema), "doc_id bigint, form string, own string")
    return keys.select("doc_id", F.unhex("form").alias("form"), F.unhex("own").alias("own"))


def clean_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``form`` (the key, see ``forms``) and ``clean``: the text to be used, without invisible characters and
    odd widths and blanks, each word in one alphabet; equal for texts that look equal. Null and empty stay so."""
    sql = f"with f as (select doc_id, {form_sql()} as form from docs), m as (select doc_id, form, {most_sql()} as m from f) select doc_id, form, {clean_sql()} as clean from m"
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("clean", pa.string())])
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_duckdb(sql, schema), "doc_id bigint, form string, clean string")


def _members(documents: DataFrame, doc_id: str, text: str, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Documents of forms with several different texts: (``doc_id``, ``form``, ``own``) and their texts (``form``, ``own``,
    ``text_id``, ``n`` documents, ``class_id``, ``texts`` of the form). Texts are counted before anything else moves."""
    docs = durable(_keys(documents, doc_id, text))
    every = durable(docs.groupBy("form", "own").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("text_id")))
    several = every.groupBy("form").agg(F.count(F.lit(1)).alias("texts"), F.min("text_id").alias("class_id"), F.sum("n").alias("documents")).where("texts > 1")
    texts = durable(lookup(every, several.select("form", "texts", "class_id"), ["form"], n="texts", spread="own", hot_rows=hot_rows))
    members = durable(lookup(docs, several.select("form", "documents"), ["form"], "left_semi", n="documents", spread="doc_id", hot_rows=hot_rows))
    return members, texts


def classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The compact form of ``lookalikes``: one row per document that looks like one with a different text: ``doc_id``,
    ``text_id`` (the smallest document with the very same text), ``class_id`` (the smallest that looks the same) and
    ``links``, the number of documents it makes a pair with."""
    members, texts = _members(documents, doc_id, text, hot_rows)
    of_form = texts.groupBy("form").agg(F.sum("n").alias("documents"))
    sized = lookup(texts, of_form.join(texts.groupBy("form").agg(F.first("texts").alias("k")), "form"), ["form"], n="k", spread="own", hot_rows=hot_rows)
    found = lookup(members, sized.select("form", "own", "n", "text_id", "class_id", (F.col("documents") - F.col("n")).alias("links")), ["form", "own"], spread="doc_id", hot_rows=hot_rows)
    return found.select("doc_id", "text_id", "class_id", "links")


def lookalikes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each pair of documents with different texts of one form: ``doc_id_a`` < ``doc_id_b``.

    Texts are counted first; only forms with several different texts go on. A document meets the other *texts* of its
    form, and then their documents, so pairs of copies of one text are never made and the work follows the result.
    Every meeting is salted by the counted rows of its key: forms of many texts, texts of many documents. Null texts
    and texts without a visible sign take no part.
    """
    members, texts = _members(documents, doc_id, text, hot_rows)
    counts = texts.select("form", "own", "n")
    other = texts.select("form", F.col("own").alias("other"), F.col("n").alias("others"), "texts")
    sizes = texts.select("form", "texts").distinct()
    # of two texts the more frequent one brings its documents, the rarer one is looked up
    meets = lookup(counts, other, ["form"], n="texts", spread="own", hot_rows=hot_rows, counts=sizes).where((F.col("n") > F.col("others")) | ((F.col("n") == F.col("others")) & (F.col("own") < F.col("other")))).select("form", "own", "n", "other", "others")
    few = members.select(F.col("doc_id").alias("b"), "form", F.col("own").alias("other"))
    rare = lookup(few, meets, ["form", "other"], n="others", spread="b", hot_rows=hot_rows, counts=counts.select("form", F.col("own").alias("other"), F.col("n").alias("others")))
    many = members.select(F.col("doc_id").alias("a"), "form", "own")
    pairs = lookup(many, rare.select("form", "own", "n", "b"), ["form", "own"], spread="a", hot_rows=hot_rows, counts=counts)
    return pairs.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
