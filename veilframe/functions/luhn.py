"""Luhn mod N check digits, alphabets and lengths."""

from __future__ import annotations

import math
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from veilframe.functions.hashing import java_trim

# The alphabets of pseudonyms ...
HEX = "ABCDEF0123456789"
DIGITS = "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
SYMBOLS_WITHOUT_BIOS = "ACDEFGHJKLMNPQRTUVWXYZ0123456789"
# ... and the orders of characters by which check digits are computed.
MOD10, MOD16, MOD26 = "0123456789", "0123456789ABCDEF", LETTERS
MOD32, MOD36 = "0123456789ACDEFGHJKLMNPQRTUVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Alphabet of each algorithm; RANDOM takes the one given, else SYMBOLS.
ALPHABETS = {
    **dict.fromkeys(["MD5", "SHA1", "SHA2", "SHA3", "BLAKE3", "XXHASH", "RANDOM_HEX"], HEX),
    **dict.fromkeys(["CONSECUTIVE", "RANDOM_NUM"], DIGITS),
    "RANDOM_LET": LETTERS, "RANDOM_SYM": SYMBOLS, "RANDOM_SYM_BIOS": SYMBOLS_WITHOUT_BIOS,
}
#: Characters of the check digit of each algorithm; CONSECUTIVE and RANDOM use their own alphabet.
CHECK_ALPHABETS = {
    **dict.fromkeys(["MD5", "SHA1", "SHA2", "SHA3", "BLAKE3", "XXHASH", "RANDOM_HEX"], MOD16),
    "RANDOM_NUM": MOD10, "RANDOM_LET": MOD26, "RANDOM_SYM_BIOS": MOD32, "RANDOM_SYM": MOD36,
}
#: The differing choice of the validation endpoint (``legacy``): RANDOM counts as digits, RANDOM_HEX isn't supported.
LEGACY_CHECK_ALPHABETS = {**{k: v for k, v in CHECK_ALPHABETS.items() if k != "RANDOM_HEX"}, "CONSECUTIVE": MOD10, "RANDOM": MOD10}

DEFAULT_ALPHABET = LETTERS
SALT_CHARACTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_+"


def alphabet_of(algorithm: str | None, given: str | None = None) -> str:
    """The alphabet of an algorithm by name; the default for none or an unknown one."""
    if algorithm is None:
        return DEFAULT_ALPHABET
    name = algorithm.strip().upper()
    if name == "RANDOM":
        return given if given and given.strip() else SYMBOLS
    return ALPHABETS.get(name, DEFAULT_ALPHABET)


def even(alphabet: str) -> str:
    """An alphabet of odd length loses its last character."""
    return alphabet[: len(alphabet) // 2 * 2]


def check_alphabet(algorithm: str, alphabet: str | None = None, legacy: bool = False) -> str:
    name = algorithm.strip().upper()
    table = LEGACY_CHECK_ALPHABETS if legacy else CHECK_ALPHABETS
    if name in table:
        return table[name]
    if name in ("CONSECUTIVE", "RANDOM") and not legacy:
        return even(alphabet or "")
    raise ValueError(f"no check digit for algorithm {algorithm}")


def standardized(c: Column, prefix: Column) -> Column:
    """Without the prefix, trimmed, upper case; null if the prefix isn't there."""
    p = F.coalesce(prefix, F.lit(""))
    return F.when(F.startswith(c, p), F.upper(java_trim(F.substring(c, F.length(p) + 1, F.length(c)))))


def _addends(alphabet: str, factor: int) -> np.ndarray:
    """For every byte the base-n digit sum of ``factor`` times the sign's index; foreign bytes count 2^40."""
    n = len(alphabet)
    table = np.full(256, _FOREIGN, np.int64)
    for index, sign in enumerate(alphabet):
        table[ord(sign)] = factor * index // n + factor * index % n
    return table


_FOREIGN = 1 << 40


def _sums(texts: pa.Array, alphabets: pa.Array, first: int) -> pa.Array:
    """Digit sums of a batch on its raw bytes: every byte is looked up by the parity of its place from the right."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    starts = offsets - offsets[0]
    kinds = alphabets.dictionary_encode()
    tables = np.stack([np.stack([_addends(a or "", first), _addends(a or "", 3 - first)]) for a in kinds.dictionary.to_pylist()] or [np.zeros((2, 256), np.int64)])
    row = np.repeat(np.arange(n), np.diff(starts))
    parity = (starts[row + 1] - 1 - np.arange(len(data))) & 1
    kind = kinds.indices.fill_null(0).to_numpy(zero_copy_only=False)[row]
    upto = np.concatenate([[0], np.cumsum(tables[kind, parity, data])])
    total = upto[starts[1:]] - upto[starts[:-1]]
    bad = (total >= _FOREIGN) | ~texts.is_valid().to_numpy(zero_copy_only=False) | ~alphabets.is_valid().to_numpy(zero_copy_only=False)
    return pa.array(total, pa.int64(), mask=bad)


@F.arrow_udf(T.LongType())
def _sums_first_twice(texts: pa.Array, alphabets: pa.Array) -> pa.Array:
    return _sums(texts, alphabets, 2)


@F.arrow_udf(T.LongType())
def _sums_first_once(texts: pa.Array, alphabets: pa.Array) -> pa.Array:
    return _sums(texts, alphabets, 1)


def digit_sum(text: Column, alphabet: str | Column, first: int) -> Column:
    """Sum of the base-n digits of factor times index over the signs, factors 2 and 1 alternating from the right
    (beginning with ``first``); null if a sign is outside the alphabet. ``alphabet`` may be a column.

    Arrow batches of raw bytes are summed at once; compiled expressions need several passes over every text (regular
    expressions, one replacement per sign) and are many times slower.
    """
    return (_sums_first_twice if first == 2 else _sums_first_once)(text, F.lit(alphabet) if isinstance(alphabet, str) else alphabet)


def digit_of(text: Column, alphabet: str) -> Column:
    """The check digit of a text in standard form; null if it has a sign outside the alphabet."""
    n = len(alphabet)
    return F.substring(F.lit(alphabet), ((n - digit_sum(text, alphabet, 2) % n) % n + 1).cast("int"), F.lit(1))


def standard_or_whole(c: Column, prefix: Column) -> Column:
    """In standard form, with the prefix left aside if it is there."""
    return F.coalesce(standardized(c, prefix), F.upper(java_trim(c)))


def compute(c: Column, prefix: Column, alphabet: str) -> Column:
    """The check digit of a pseudonym (prefix, if there, left aside); null if it has a sign outside the alphabet."""
    return digit_of(standard_or_whole(c, prefix), alphabet)


def valid(c: Column, prefix: Column, alphabet: str) -> Column:
    """Whether the last sign is the right check digit; false without the prefix, null at a foreign sign."""
    text = standardized(c, prefix)
    return F.when(c.isNotNull() & text.isNull(), F.lit(False)).otherwise(digit_sum(text, alphabet, 1) % len(alphabet) == 0)


def with_check_digit(rows: DataFrame, psn: str, prefix: Column, alphabet: str | Column, included: Column, consecutive: Column, name: str) -> DataFrame:
    """``rows`` with the pseudonym of column ``psn`` and its check digit as ``name``; ``included`` first drops the last
    sign, except of consecutive numbers; without a digit the pseudonym stays as it is.

    What is used several times is a column of its own, so that it is worked out once. ``alphabet`` may be a column of
    the rows.
    """
    c = F.col(psn)
    body = F.when(included & ~consecutive, F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    signs = F.lit(alphabet) if isinstance(alphabet, str) else alphabet
    n = F.length(signs)
    staged = rows.withColumn("_body", body).withColumn("_standard", standard_or_whole(F.col("_body"), prefix))
    staged = staged.withColumn("_sum", digit_sum(F.col("_standard"), alphabet, 2))
    digit = F.substring(signs, ((n - F.col("_sum") % n) % n + 1).cast("int"), F.lit(1))
    return staged.withColumn(name, F.coalesce(F.concat("_body", digit), c)).drop("_body", "_standard", "_sum")


def corrected_length(c: Column, length: Column, padding: Column, pad: bool = True) -> Column:
    """The first ``length`` signs of a longer text; a shorter one is padded on the left (if ``pad``)."""
    cut = F.substring(c, F.lit(1), length)
    return F.when(F.length(c) < length, F.concat(F.repeat(padding, length - F.length(c)), c)).otherwise(cut) if pad else cut


def pseudonym_length(size: int, probability: float, alphabet_size: int) -> int:
    """Signs needed so that ``size`` random pseudonyms succeed within three attempts with this probability."""
    space = math.ceil(size / (1 - probability) ** (1 / 3))
    return math.ceil(math.log(space) / math.log(alphabet_size))


def pseudonym_length_column(size: Column, probability: Column, alphabet_size: Column) -> Column:
    space = F.ceil(size / F.pow(1 - probability, F.lit(1 / 3)))
    return F.ceil(F.ln(space) / F.ln(alphabet_size)).cast("int")


def fill_limit(length: Column, probability: Column) -> Column:
    """Pseudonyms beyond which a domain counts as too full; the base is 10 whatever the alphabet."""
    return F.pow(F.lit(10.0), length) * F.pow(1 - probability, F.lit(1 / 3))


def generate_salt(length: int = 32) -> str:
    return "".join(secrets.choice(SALT_CHARACTERS) for _ in range(length))


def valid_salt(salt: str | None, least: int = 8, most: int = 256) -> bool:
    return salt is not None and least <= len(salt) <= most and bool(salt.strip())
