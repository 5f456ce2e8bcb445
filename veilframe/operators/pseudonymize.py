"""Making pseudonyms: hashing, counting or drawing, with prefix, length and check digit."""

from __future__ import annotations

import secrets
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from veilframe.functions import hashing, luhn
from veilframe.functions.hashing import java_trim


@dataclass(frozen=True)
class Scheme:
    """How a domain (or a stand-alone algorithm) makes its pseudonyms."""

    algorithm: str = "MD5"
    prefix: str = ""
    length: int = 32
    padding: str = "0"
    salt: str = ""
    alphabet: str | None = None
    check_digit: bool = False
    digit_included: bool = False
    multiple: bool = False
    counter: int = 0

    @property
    def name(self) -> str:
        return self.algorithm.strip().upper()

    @property
    def signs(self) -> str:
        return luhn.alphabet_of(self.algorithm, self.alphabet)


def hashed(text: Column, scheme: Scheme) -> Column:
    if scheme.name == "XXHASH":
        return hashing.xxhash(text, scheme.salt)
    return hashing.HASHES[scheme.name](text)


def finished(rows: DataFrame, raw: Column, scheme: Scheme, omit_prefix: bool, name: str) -> DataFrame:
    """``rows`` with prefix, length and check digit put on a raw value; each step is a column, worked out once."""
    prefix = "" if omit_prefix else scheme.prefix
    staged = rows.withColumn("_raw", raw)
    psn = F.concat(F.lit(prefix), luhn.corrected_length(F.col("_raw"), F.lit(scheme.length), F.lit(scheme.padding)))
    if not scheme.check_digit:
        return staged.withColumn(name, psn).drop("_raw")
    alphabet = luhn.check_alphabet(scheme.name, scheme.signs)
    staged = staged.withColumn("_psn", psn)
    return luhn.with_check_digit(staged, "_psn", F.lit(prefix), alphabet, F.lit(scheme.digit_included), F.lit(scheme.name == "CONSECUTIVE"), name).drop("_raw", "_psn")


def numbered(rows: DataFrame, keys: list[str], start: int, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` numbered from ``start`` + 1 in the order of ``keys`` (unique), without one task for all rows.

    Rows are range-partitioned by the keys and counted per partition; offsets of the partitions, one row each, are
    added to the numbers within. The partitioned rows are written out first, so both passes see the same ranges.
    """
    from veilframe.plans.durable import durable

    spread = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = durable(rows.repartitionByRange(spread, *keys).sortWithinPartitions(*keys).withColumn("_mark", F.monotonically_increasing_id()))
    placed = ordered.withColumn("_part", F.shiftright("_mark", 33)).withColumn("_within", F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.lit(start) + F.col("_offset") + F.col("_within") + 1).drop("_mark", "_part", "_within", "_offset")


def numbered_within(rows: DataFrame, group: str, keys: list[str], name: str, parts: int | None = None) -> DataFrame:
    """``rows`` numbered from 1 within each ``group`` in the order of ``keys`` (unique), however many rows a group has.

    Rows are range-partitioned by group and keys, so a large group spans several partitions; each adds the counts of
    the group's rows in the partitions before, of which there is one row per group and partition.
    """
    from veilframe.plans.durable import durable

    spread = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = durable(rows.repartitionByRange(spread, group, *keys).sortWithinPartitions(group, *keys).withColumn("_mark", F.monotonically_increasing_id()))
    placed = ordered.withColumn("_part", F.shiftright("_mark", 33))
    runs = placed.groupBy("_part", F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"), F.min("_mark").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("_part", "_group", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = placed.join(offsets, (placed["_part"] == offsets["_part"]) & placed[group].eqNullSafe(offsets["_group"])).drop(offsets["_part"])
    return joined.withColumn(name, F.col("_offset") + F.col("_mark") - F.col("_first") + 1).drop("_mark", "_part", "_group", "_first", "_offset")


def _drawn(alphabets: pd.Series, lengths: pd.Series, generator: np.random.Generator | None) -> pd.Series:
    """One text per row, each sign drawn evenly from the row's alphabet; by the operating system's generator unless a
    seeded one is given. 64 bits are drawn a sign, so that no sign is likelier than another by more than 2^-57."""
    sizes = [0 if a is None or not a.strip() or n is None or n != n else max(0, int(n)) for a, n in zip(alphabets, lengths)]
    total = sum(sizes)
    words = np.frombuffer(secrets.token_bytes(8 * total), np.uint64) if generator is None else generator.integers(0, 1 << 63, total, dtype=np.uint64)
    out, at = [], 0
    for alphabet, size, length in zip(alphabets, sizes, lengths):
        if alphabet is None or not alphabet.strip() or length is None or length != length:
            out.append(None)
            continue
        out.append("".join([alphabet[k] for k in (words[at : at + size] % np.uint64(len(alphabet))).tolist()]))
        at += size
    return pd.Series(out, index=alphabets.index, dtype=object)


def random_text(alphabet: Column, length: Column, seed: int | None = None) -> Column:
    """``length`` signs drawn from the alphabet; null for a blank one. Secret unless a ``seed`` is given (for tests)."""

    @F.pandas_udf(T.StringType())
    def secret(alphabets: pd.Series, lengths: pd.Series) -> pd.Series:
        return _drawn(alphabets, lengths, None)

    @F.pandas_udf(T.StringType())
    def seeded(alphabets: pd.Series, lengths: pd.Series, marks: pd.Series) -> pd.Series:
        return _drawn(alphabets, lengths, np.random.default_rng([seed, int(marks.iloc[0])] if len(marks) else seed))

    if seed is None:
        return secret.asNondeterministic()(alphabet, length)
    return seeded.asNondeterministic()(alphabet, length, F.monotonically_increasing_id())


def pseudonymize(rows: DataFrame, scheme: Scheme, identifier: str = "identifier", idtype: str = "idtype", order: str | None = None, omit_prefix: bool = False, name: str = "psn", seed: int | None = None) -> DataFrame:
    """``rows`` with a pseudonym of identifier + type + salt (null if either is null) under the scheme.

    Hash schemes are plain expressions. With ``multiple`` the hash also takes a running counter, so that equal
    identifiers differ; CONSECUTIVE is the counter itself; both number the rows in the order of ``order`` (default:
    identifier and type, ties at random). Other schemes draw secret random signs, unless a ``seed`` is given; unknown
    ones draw letters. Drawn and counted pseudonyms differ at each evaluation: write the result out before using it
    twice.
    """
    text = F.concat(F.col(identifier), F.col(idtype), F.lit(scheme.salt or ""))
    keys = [order] if order else [identifier, idtype]
    if scheme.name == "CONSECUTIVE":
        counted = numbered(rows, keys, scheme.counter, "_count")
        return finished(counted, F.col("_count").cast("string"), scheme, omit_prefix, name).drop("_count")
    if scheme.name in hashing.HASHES or scheme.name == "XXHASH":
        if scheme.multiple:
            counted = numbered(rows, keys, scheme.counter - 1, "_count")
            return finished(counted, hashed(F.concat(text, F.col("_count").cast("string")), scheme), scheme, omit_prefix, name).drop("_count")
        return finished(rows, hashed(text, scheme), scheme, omit_prefix, name)
    return finished(rows, random_text(F.lit(scheme.signs), F.lit(scheme.length), seed), scheme, omit_prefix, name)


#: Algorithms by what they do with the counter of their domain.
HASHING = ["MD5", "SHA1", "SHA2", "SHA3", "BLAKE3", "XXHASH"]
DRAWING = ["RANDOM", "RANDOM_NUM", "RANDOM_HEX", "RANDOM_LET", "RANDOM_SYM", "RANDOM_SYM_BIOS"]


@F.pandas_udf(T.LongType())
def _seed_words(salts: pd.Series) -> pd.Series:
    return pd.Series([hashing.seed_word(hashing.salt_seed(s)) for s in salts], index=salts.index)


def settings(domains: DataFrame) -> DataFrame:
    """What making a pseudonym needs to know of each domain (``domainid``), one row per domain: algorithm (unknown ones
    draw letters; a blank one is null), prefix, salt, length, padding, counter and the alphabets of body and digit."""
    given = F.upper(F.trim("algorithm"))
    algorithm = F.when(F.coalesce(given, F.lit("")) == "", F.lit(None)).when(given.isin([*HASHING, *DRAWING, "CONSECUTIVE"]), given).otherwise("RANDOM_LET")
    column = lambda name, other: F.coalesce(F.col(name), F.lit(other)) if name in domains.columns else F.lit(other)
    of = lambda table: F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.col("_a"))
    own = F.when(F.length(F.trim(column("alphabet", ""))) > 0, column("alphabet", "")).otherwise(luhn.SYMBOLS)
    even = F.substring(column("alphabet", ""), F.lit(1), (F.floor(F.length(column("alphabet", "")) / 2) * 2).cast("int"))
    rows = domains.select(F.col("id").alias("domainid"), algorithm.alias("_a"), column("prefix", "").alias("_p"), column("salt", "").alias("_s"), F.col("pseudonymlength").alias("_l"), column("paddingcharacter", "0").alias("_c"), column("addcheckdigit", False).alias("_d"), column("lengthincludescheckdigit", False).alias("_i"), column("multiplepsnallowed", False).alias("_m"), column("consecutivevaluecounter", 0).cast("long").alias("_n"), own.alias("_own"), even.alias("_even"))
    signs = F.when(F.col("_a") == "RANDOM", F.col("_own")).otherwise(of(luhn.ALPHABETS))
    digits = F.when(F.col("_a").isin("CONSECUTIVE", "RANDOM"), F.col("_even")).otherwise(of(luhn.CHECK_ALPHABETS))
    return rows.withColumn("_signs", signs).withColumn("_digits", digits).withColumn("_counts", counting()).withColumn("_w", _seed_words("_s")).drop("_own", "_even")


def counting() -> Column:
    """Whether a domain's counter advances with each pseudonym: it counts, or hashes and allows several per identifier."""
    return (F.col("_a") == "CONSECUTIVE") | (F.col("_m") & F.col("_a").isin(HASHING))


def by_domain(rows: DataFrame, domains: DataFrame, name: str = "psn", order: str | None = None, seed: int | None = None) -> DataFrame:
    """``rows`` (``identifier``, ``idtype``, ``domainid``) with pseudonyms by the settings of each row's domain.

    Every algorithm works here. Hashes are expressions of identifier + type + salt, in domains that allow several
    pseudonyms also of the counter before it advances; counting domains give counter + 1 and so on, in the order of
    ``order`` (unique; default: identifier and type) within the domain; drawing ones secret random signs (``seed`` is
    for tests). Without an identifier, a type or a known domain with an algorithm the pseudonym is null.

    Only rows of domains that count are numbered (see ``numbered_within``); only a scheme that is in use is worked out
    for a row, and only of schemes that some domain uses. The domains are configuration; whether they are broadcast is left to their measured size. Drawn and
    counted values differ at each evaluation: write the result out before using it twice, and store ``advanced``.
    """
    # which algorithms are in use: never more rows than there are algorithms and flags
    used = settings(domains).select("_a", "_counts", "_d").distinct().collect()
    names = {r["_a"] for r in used}
    usable = F.col("identifier").isNotNull() & F.col("idtype").isNotNull() & F.col("_a").isNotNull()
    joined = rows.join(settings(domains), "domainid", "left").withColumn("_usable", usable)
    keys = [order] if order else ["identifier", "idtype"]
    counts = F.coalesce(F.col("_usable") & F.col("_counts"), F.lit(False))
    if not any(r["_counts"] for r in used):
        joined = joined.withColumn("_count", F.lit(None).cast("long"))
    else:
        counted = numbered_within(joined.where(counts), "domainid", keys, "_rank").withColumn("_count", F.col("_n") + F.col("_rank")).drop("_rank")
        joined = counted.unionByName(joined.where(~counts).withColumn("_count", F.lit(None).cast("long")))
    text = F.concat("identifier", "idtype", "_s", F.when(F.col("_m"), (F.col("_count") - 1).cast("string")).otherwise(""))
    joined = joined.withColumn("_text", F.when(F.col("_a").isin(HASHING), text))
    is_a = lambda a: F.col("_a") == a
    raw = F.when(~F.col("_usable"), F.lit(None)).when(is_a("CONSECUTIVE"), F.col("_count").cast("string"))
    for algorithm, make in hashing.HASHES.items():
        if algorithm != "BLAKE3" and algorithm in names:
            raw = raw.when(is_a(algorithm), make(F.col("_text")))
    if "XXHASH" in names:
        raw = raw.when(is_a("XXHASH"), F.lpad(F.lower(F.hex(F.xxhash64("_w", "_text"))), 16, "0"))
    made = [raw]
    # Python works on the rows that need it; the others are null there
    if "BLAKE3" in names:
        joined = joined.withColumn("_blake", hashing.blake3(F.when(F.col("_usable") & is_a("BLAKE3"), F.col("_text"))))
        made.append(F.col("_blake"))
    if names & set(DRAWING):
        joined = joined.withColumn("_random", random_text(F.when(F.col("_usable") & F.col("_a").isin(DRAWING), F.col("_signs")), F.col("_l"), seed))
        made.append(F.col("_random"))
    joined = joined.withColumn("_raw", F.coalesce(*made))
    joined = joined.withColumn("_psn", F.concat("_p", luhn.corrected_length(F.col("_raw"), F.col("_l"), F.col("_c"))))
    if not any(r["_d"] for r in used):
        return joined.withColumn(name, F.col("_psn")).select(*rows.columns, name)
    digits = luhn.with_check_digit(joined, "_psn", F.col("_p"), F.when(F.col("_d"), F.col("_digits")), F.col("_i"), is_a("CONSECUTIVE"), "_digit")
    return digits.withColumn(name, F.when(F.col("_d"), F.col("_digit")).otherwise(F.col("_psn"))).select(*rows.columns, name)


def advanced(domains: DataFrame, made: DataFrame) -> DataFrame:
    """Domains after ``made`` (``domainid``, one row per pseudonym made): the counters of those that count went on by as
    many. Rows are counted before they meet the domains; a table without counters stays as it is."""
    if "consecutivevaluecounter" not in domains.columns:
        return domains
    used = made.groupBy("domainid").agg(F.count(F.lit(1)).alias("_used")).join(settings(domains).where("_counts").select("domainid"), "domainid", "left_semi")
    joined = domains.join(used, domains["id"] == used["domainid"], "left").drop(used["domainid"])
    return joined.withColumn("consecutivevaluecounter", F.when(F.col("_used").isNotNull(), F.coalesce("consecutivevaluecounter", F.lit(0)) + F.col("_used")).otherwise(F.col("consecutivevaluecounter"))).select(*domains.columns)


def supplied(psn: Column, prefix: Column, omit_prefix: bool = False) -> Column:
    """A caller's own pseudonym: trimmed, with the prefix unless it is there or omitted."""
    text = java_trim(psn)
    return text if omit_prefix else F.when(F.startswith(text, prefix), text).otherwise(F.concat(prefix, text))


def fill_rate(domains: DataFrame, pseudonyms: DataFrame) -> DataFrame:
    """``domainid``, ``amount``, ``too_full``: more pseudonyms than the random space bears at the wanted probability."""
    held = pseudonyms.groupBy("domainid").agg(F.count(F.lit(1)).alias("amount"))
    return domains.select(F.col("id").alias("domainid"), "pseudonymlength", F.col("randomalgorithmdesiredsuccessprobability").alias("_t")).join(held, "domainid", "left").select("domainid", F.coalesce("amount", F.lit(0)).alias("amount"), (F.coalesce("amount", F.lit(0)) > luhn.fill_limit(F.col("pseudonymlength"), F.col("_t"))).alias("too_full"))
