"""Privacy-preserving linkage: keyed tokens, Bloom filters of n-grams, bands."""

from __future__ import annotations

import base64
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Set apart the messages of this library and version; configurable, so that tokens made elsewhere can be matched.
CONTEXT = "veilframe|pprl|v1"


@dataclass(frozen=True)
class Pprl:
    """Parameters of the encoding; values below the floor are raised to it."""

    secret: str
    method: str = "ngramBloomFilter"
    n: int = 2
    length: int = 1024
    positions: int = 10
    band: int = 32
    exact: bool = False
    context: str = CONTEXT

    def floored(self) -> Pprl:
        if not self.secret:
            raise ValueError("privacy-preserving linkage needs a secret")
        return Pprl(self.secret, self.method, max(2, self.n), max(128, self.length), max(1, self.positions), max(8, self.band), self.exact, self.context)


def hmac_sha256(message: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 by built-in hashing; the key's two pads are literals, so keep plans out of logs."""
    import hashlib

    key = secret.encode("utf-8")
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ p for k in key)) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def base64url(binary: Column) -> Column:
    return F.rtrim(F.translate(F.base64(binary), "+/\r\n", "-_"), F.lit("="))


def message(p: Pprl, project: Column, kind: Column, tag: Column, category: str, value: Column) -> Column:
    return F.concat_ws("|", F.lit(p.context), project.cast("string"), kind.cast("string"), tag, F.lit(category), value)


def exact_token(p: Pprl, project: Column, kind: Column, tag: Column, value: Column) -> Column:
    return F.when(value.isNotNull(), base64url(F.unhex(hmac_sha256(message(p, project, kind, tag, "exact", value), p.secret))))


def ngrams(value: Column, n: int) -> Column:
    """Different n-grams of ^value$; a shorter text is its own and only n-gram."""
    text = F.concat(F.lit("^"), value, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(text) <= n, F.array(text)).otherwise(grams))


def bloom_positions(p: Pprl, project: Column, kind: Column, tag: Column, value: Column) -> Column:
    """Set bits, ascending: of each n-gram and hash number the first four HMAC bytes as a signed number, modulo the
    length."""
    p = p.floored()

    def bit(gram: Column, i: Column) -> Column:
        head = F.conv(F.substring(hmac_sha256(message(p, project, kind, tag, "ngram", F.concat_ws("|", gram, i.cast("string"))), p.secret), 1, 8), 16, 10).cast("bigint")
        return F.pmod(F.when(head >= 1 << 31, head - (1 << 32)).otherwise(head), F.lit(p.length)).cast("int")

    bits = F.flatten(F.transform(ngrams(value, p.n), lambda gram: F.transform(F.sequence(F.lit(0), F.lit(p.positions - 1)), lambda i: bit(gram, i))))
    return F.when(value.isNotNull(), F.array_sort(F.array_distinct(bits)))


def bloom_by_value(values, p: Pprl, project: Column, kind: Column, tag: Column, value: str):
    """Bloom filters of a column, each different value encoded once: thousands of hashes per value are worth a join, and
    a fixed number of tasks, since adaptive execution would put these few bytes into one.

    Returns ``values`` with ``bloom``; rows whose value is null get null.
    """
    keys = values.select(project.alias("_p"), kind.alias("_k"), tag.alias("_t"), F.col(value).alias("_v")).where("_v is not null").distinct().repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    encoded = keys.withColumn("bloom", bloom_positions(p, F.col("_p"), F.col("_k"), F.col("_t"), F.col("_v")))
    on = (project == F.col("_p")) & (kind == F.col("_k")) & (tag == F.col("_t")) & (F.col(value) == F.col("_v"))
    return values.join(encoded, on, "left").drop("_p", "_k", "_t", "_v")


def band_tokens(p: Pprl, project: Column, kind: Column, tag: Column, bits: Column) -> Column:
    """One keyed token per band with a set bit; its message holds the band's number and its bits."""
    p = p.floored()
    bands = -(-p.length // p.band)

    def token(k: Column) -> Column:
        end = F.least((k + 1) * p.band, F.lit(p.length))
        text = F.array_join(F.transform(F.sequence(k * p.band, end - 1), lambda i: F.when(F.array_contains(bits, i), "1").otherwise("0")), "")
        return F.when(F.contains(text, F.lit("1")), base64url(F.unhex(hmac_sha256(message(p, project, kind, tag, "band", F.concat_ws("|", k.cast("string"), text)), p.secret))))

    return F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), token))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared bits over all bits; 0 when both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))


def encode_bits(length: int):
    """The stored form of set bits: little-endian bytes of the filter, base64url without padding."""

    @F.pandas_udf(T.StringType())
    def run(bits: pd.Series) -> pd.Series:
        def one(some: Sequence[int] | None) -> str | None:
            if some is None:
                return None
            data = bytearray(-(-length // 8))
            for b in some:
                data[b >> 3] |= 1 << (b & 7)
            return base64.urlsafe_b64encode(bytes(data)).rstrip(b"=").decode()

        return bits.map(one)

    return run


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def decode_bits(stored: pd.Series) -> pd.Series:
    """Set bits of the stored form."""

    def one(text: str | None) -> list[int] | None:
        if text is None:
            return None
        data = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
        return [8 * k + j for k, byte in enumerate(data) for j in range(8) if byte >> j & 1]

    return stored.map(one)
