"""Validity periods: texts such as "8 w", flexible dates, clamping to a domain."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veilframe.functions.hashing import java_trim

# Names of the units of time.
UNITS = {
    "years": ["y", "yr", "yrs", "year", "years"],
    "months": ["mo", "mos", "mon", "mons", "mth", "mths", "month", "months"],
    "weeks": ["w", "wk", "wks", "week", "weeks"],
    "days": ["d", "day", "days"],
    "hours": ["h", "hr", "hrs", "hour", "hours"],
    "minutes": ["m", "min", "mins", "minute", "minutes"],
    "seconds": ["s", "sec", "secs", "second", "seconds"],
    "milliseconds": ["ms", "msec", "msecs", "millis", "millisecond", "milliseconds"],
    "nanoseconds": ["ns", "nsec", "nsecs", "nanosec", "nanosecs", "nanosecond", "nanoseconds", "nano", "nanos"],
}
PERIOD = r"^\s*([+-]?\d+)\s*([a-zA-Z]+)\s*\.?\s*$"
#: Beyond this many of a unit a sum leaves the range of timestamps; the result is null.
MOST = {"years": 200_000, "months": 2_400_000, "weeks": 10_000_000, "days": 70_000_000, "hours": 1_000_000_000, "minutes": 10**11, "seconds": 10**12, "milliseconds": 10**15, "nanoseconds": 9 * 10**18}


def plus(start: Column, period: Column, legacy: bool = False) -> Column:
    """``start`` plus a period; null if the period is null, malformed, of an unknown unit or out of range.

    A trailing dot and a sign are allowed; "m" are minutes; months clamp to the month's end. ``legacy`` keeps the
    older behaviour by which a millisecond counts as a microsecond.
    """
    text = F.lower(java_trim(period))
    amount = F.regexp_extract(text, PERIOD, 1).try_cast("bigint")
    unit = F.regexp_extract(text, PERIOD, 2)
    inside = lambda name: unit.isin(UNITS[name]) & (F.abs(amount) <= MOST[name])
    micros = F.when(inside("weeks"), amount * 604_800_000_000).when(inside("days"), amount * 86_400_000_000).when(inside("hours"), amount * 3_600_000_000).when(inside("minutes"), amount * 60_000_000)
    micros = micros.when(inside("seconds"), amount * 1_000_000).when(inside("milliseconds"), amount * (1 if legacy else 1000)).when(inside("nanoseconds"), F.floor(amount / 1000).cast("bigint"))
    months = F.when(inside("years"), amount * 12).when(inside("months"), amount)
    by_months = start + F.make_ym_interval(F.lit(0), F.coalesce(months, F.lit(0)).cast("int"))
    by_micros = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.coalesce(micros, F.lit(0)) / F.lit(1_000_000)).cast("decimal(18,6)"))
    return F.when(months.isNotNull(), by_months).when(micros.isNotNull(), by_micros)


#: Formats of date and time; each may also carry an offset or Z.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS"]


def parse(text: Column) -> Column:
    """A date, optionally with a time after a T or blank and an offset; null if it is none of this.

    Without an offset the time is that of the session's zone. The result is a timestamp.
    """
    t = java_trim(text)
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?\s*(Z|[+-]\d{2}:\d{2})?$"
    dated = F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2})\s*(Z|[+-]\d{2}:\d{2})$", "$1T00:00:00$2")
    full = F.regexp_replace(F.regexp_replace(dated, r"([T ]\d{2}:\d{2})\s*(Z|[+-]\d{2}:\d{2})?$", "$1:00$2"), r"\s+(Z|[+-]\d{2}:\d{2})$", "$1")
    return F.when(t.rlike(shape), F.when(dated.rlike(r"[T ]\d{2}:\d{2}"), full).otherwise(dated).try_cast("timestamp"))


def clamp_start(given: Column, domain_from: Column, enforced: Column) -> tuple[Column, Column]:
    """The start of a pseudonym and whether it is inherited: not before the domain's if that is enforced, else as
    given; the domain's if none is given."""
    bounded = F.when(given.isNull(), domain_from).when(enforced, F.greatest(given, domain_from)).otherwise(given)
    return bounded, given.isNull() | (F.coalesce(enforced, F.lit(False)) & ~(given > domain_from))


def wanted_end(given: Column, period: Column, start: Column) -> Column:
    """The end asked for: an explicit one goes before a period, which counts from ``start``."""
    return F.coalesce(given, plus(start, period))


def clamp_end(wanted: Column, domain_to: Column, enforced: Column) -> tuple[Column, Column]:
    """The end of a pseudonym and whether it is inherited: not after the domain's if that is enforced, else as wanted;
    the domain's if none is. Give ``wanted`` as a column of its own, not as the long expression of ``wanted_end``."""
    bounded = F.when(wanted.isNull(), domain_to).when(enforced, F.least(wanted, domain_to)).otherwise(wanted)
    return bounded, wanted.isNull() | (F.coalesce(enforced, F.lit(False)) & ~(wanted < domain_to))


def valid_at(start: Column, end: Column, moment: Column) -> Column:
    """Half-open validity; a null bound is open."""
    return (start.isNull() | (start <= moment)) & (end.isNull() | (end > moment))


def updated_start(given: Column, old: Column, domain_from: Column, enforced: Column) -> Column:
    """The start after an update: the new one within the domain's, or the old one if none is given."""
    return F.when(given.isNull(), old).when(enforced, F.greatest(given, domain_from)).otherwise(given)


def updated_end(wanted: Column, old: Column, domain_to: Column, enforced: Column) -> Column:
    """The end after an update, likewise."""
    return F.when(wanted.isNull(), old).when(enforced, F.least(wanted, domain_to)).otherwise(wanted)
