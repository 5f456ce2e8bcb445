"""Hash pseudonyms as column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from veilframe.functions.blake3 import blake3_hex

_MASK = (1 << 64) - 1
# Fixed values of the published XXH64 algorithm.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def java_trim(c: Column) -> Column:
    """Without characters up to U+0020 at either end."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def md5(c: Column) -> Column:
    return F.upper(F.md5(java_trim(c)))


def sha1(c: Column) -> Column:
    return F.upper(F.sha1(java_trim(c)))


def sha2(c: Column) -> Column:
    """SHA-512."""
    return F.upper(F.sha2(java_trim(c), 512))


def sha3(c: Column) -> Column:
    """SHA3-512, by the codec library on Spark's class path; null stays null."""
    trimmed = java_trim(c)
    return F.when(trimmed.isNotNull(), F.upper(F.reflect(F.lit("org.apache.commons.codec.digest.DigestUtils"), F.lit("sha3_512Hex"), trimmed)))


@F.pandas_udf(T.StringType())
def _blake3(values: pd.Series) -> pd.Series:
    return pd.Series(blake3_hex([None if v is None else v for v in values]), index=values.index, dtype=object)


def blake3(c: Column) -> Column:
    """BLAKE3-256, untrimmed."""
    return F.upper(_blake3(c))


def _unshift(x: int, n: int) -> int:
    """Inverse of x ^ (x >> n)."""
    out = x
    for _ in range(64 // n + 1):
        out = x ^ (out >> n)
    return out


def seed_word(seed: int) -> int:
    """The long whose XXH64 under Spark's fixed seed 42 is ``seed``: hashed first, it sets the seed of what follows.

    Every step of hashing one long is a bijection and is undone here, last step first.
    """
    inverse = lambda p: pow(p, -1, 1 << 64)
    turn = lambda x, n: ((x >> n) | (x << (64 - n))) & _MASK
    h = _unshift(seed & _MASK, 32)
    h = _unshift(h * inverse(_P3) & _MASK, 29)
    h = _unshift(h * inverse(_P2) & _MASK, 33)
    h = turn((h - _P4) * inverse(_P1) & _MASK, 27)
    h ^= (42 + _P5 + 8) & _MASK
    h = turn(h * inverse(_P1) & _MASK, 31)
    value = h * inverse(_P2) & _MASK
    return value - (1 << 64) if value >> 63 else value


def salt_seed(salt: str | None) -> int:
    """First eight bytes of the salt's SHA-256 as a big-endian number; 0 for a blank salt."""
    return int.from_bytes(hashlib.sha256(salt.encode()).digest()[:8], "big") if salt and salt.strip() else 0


def xxhash(c: Column, salt: str | None = None) -> Column:
    """XXH64 seeded by the salt, lower-case hex of 16 digits, untrimmed."""
    return F.when(c.isNotNull(), F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed_word(salt_seed(salt))), c))), 16, "0"))


#: Hash algorithms by name. XXHASH also takes the salt.
HASHES: dict[str, Callable[[Column], Column]] = {"MD5": md5, "SHA1": sha1, "SHA2": sha2, "SHA3": sha3, "BLAKE3": blake3}
