"""Sessions of activity separated by inactivity, by pairing starts with ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from veilframe.plans.durable import durable
from veilframe.plans.prefix import neighbours, running, with_blocks
from veilframe.plans.skew import HOT_ROWS

#: A user's new session begins when more than this has passed (30 minutes).
GAP_US = 1_800_000_000

def moments(events: DataFrame, key: str, time: str, event_id: str, gap_us: int, hot_rows: int) -> DataFrame:
    """One row per key and moment with ``n`` events, first and last id, and whether a session starts or ends there.

    Events of a moment are aggregated before the shuffle and written out once; everything after reads that table.
    RANGE frames look for another moment within ``gap_us`` before and after. A hot key's moments are cut into blocks
    by count; at the borders of a block the nearest moment of the key's next block is looked at as well.
    """
    rows = events.select(F.col(key).alias("key"), F.col(time).cast("long").alias("t"), F.col(event_id).alias("id")).dropna(subset=["key", "t"])
    table = durable(rows.groupBy("key", "t").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")))
    blocked = with_blocks(table, ["key"], "t", hot_rows)
    order = Window.partitionBy("key", "block").orderBy("t")
    before, after = order.rangeBetween(-gap_us, -1), order.rangeBetween(1, gap_us)
    seen = blocked.withColumn("starts", F.count(F.lit(1)).over(before) == 0).withColumn("ends", F.count(F.lit(1)).over(after) == 0)
    beyond = seen.join(neighbours(blocked, ["key"], "t"), ["key", "block"], "left")
    near = lambda a, b: F.coalesce(a - b <= gap_us, F.lit(False))
    return beyond.withColumn("starts", F.col("starts") & ~near(F.col("t"), F.col("before"))).withColumn("ends", F.col("ends") & ~near(F.col("after"), F.col("t"))).drop("before", "after")


def ranked(events: DataFrame, key: str, time: str, event_id: str, gap_us: int, hot_rows: int) -> DataFrame:
    """The moments with the numbers of events, starts and ends of their key up to them."""
    return running(moments(events, key, time, event_id, gap_us, hot_rows), ["key"], ["t"], sums={
        "so_far": F.col("n"),
        "start_no": F.col("starts").cast("long"),
        "end_no": F.col("ends").cast("long"),
    })


def paired(rows: DataFrame) -> DataFrame:
    """Sessions from ranked moments: starts and ends of a key with equal ranks belong together."""
    starts = rows.where("starts").select("key", F.col("start_no").alias("session"), F.col("first_id"), F.col("t").alias("start_us"), (F.col("so_far") - F.col("n")).alias("earlier"))
    ends = rows.where("ends").select("key", F.col("end_no").alias("session"), F.col("last_id"), F.col("t").alias("end_us"), "so_far")
    return starts.join(ends, ["key", "session"]).select("key", "session", "first_id", "last_id", "start_us", "end_us", (F.col("so_far") - F.col("earlier")).alias("n"))


def sessions(events: DataFrame, key: str, time: str, event_id: str, gap_us: int = GAP_US, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per session: ``key``, ``session`` (from 1), ``first_id``, ``last_id``, ``start_us``, ``end_us``, ``n``.

    ``time`` is in microseconds. A moment without a predecessor within ``gap_us`` starts a session, one without a
    successor ends it. Starts and ends are numbered separately per key and joined on equal numbers; the number of
    events is the difference of the running counts. First and last event are by (time, id). Rows without key or time
    take no part; equal times fall into one moment; an empty table gives no session.
    """
    # only starts and ends go on, and both come from one table
    return paired(durable(ranked(events, key, time, event_id, gap_us, hot_rows).where("starts or ends")))


def numbered(events: DataFrame, key: str, time: str, gap_us: int = GAP_US, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``key``, ``t`` and ``session`` of every moment, to be joined to its events."""
    return ranked(events.withColumn("_no", F.lit(0)), key, time, "_no", gap_us, hot_rows).select("key", "t", F.col("start_no").alias("session"))


def sessions_with_values(events: DataFrame, key: str, time: str, event_id: str, value: str, gap_us: int = GAP_US, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``sessions`` with ``distinct_values``, how many different non-null values each saw; moments are ranked once."""
    rows = durable(ranked(events, key, time, event_id, gap_us, hot_rows))
    counted = _values(events, key, time, value, rows.select("key", "t", F.col("start_no").alias("session")))
    return paired(rows).join(counted, ["key", "session"], "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0).cast("long")))


def session_values(events: DataFrame, key: str, time: str, value: str, gap_us: int = GAP_US, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``key``, ``session`` and ``distinct_values``: how many different non-null values a session saw; sessions without
    any have no row."""
    return _values(events, key, time, value, numbered(events, key, time, gap_us, hot_rows))


def _values(events: DataFrame, key: str, time: str, value: str, number: DataFrame) -> DataFrame:
    """Events are first reduced to distinct (key, moment, value), so what joins is no longer skewed by repetition."""
    values = events.select(F.col(key).alias("key"), F.col(time).cast("long").alias("t"), F.col(value).alias("value")).dropna().distinct()
    return values.join(number, ["key", "t"]).select("key", "session", "value").distinct().groupBy("key", "session").agg(F.count(F.lit(1)).alias("distinct_values"))
