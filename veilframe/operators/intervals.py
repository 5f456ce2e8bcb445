"""Continuous periods and gaps of time intervals by a sweep line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from veilframe.plans.durable import durable
from veilframe.plans.prefix import running, with_blocks
from veilframe.plans.skew import HOT_ROWS

def sweep(intervals: DataFrame, keys: Sequence[str], start: str, end: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Merges half-open intervals ``[start, end)`` (integers) of each key and lists the gaps.

    Every interval becomes a plus event at its start and a minus event at its end; events of one key and moment are
    summed before the shuffle. The prefix sum of the deltas is the number of active intervals: a period starts where
    it leaves zero and ends where it returns to zero, so intervals that only meet are one period. Returns the keys,
    ``kind`` (period or gap), ``from_us``, ``to_us`` and, for periods, ``n`` intervals that formed it (gaps: null).

    Rows with a null bound, a null key or an end not after the start take no part. Equal rows count each. An empty
    input gives an empty result. Extra columns are ignored. A key of more than ``hot_rows`` moments is swept in blocks
    of about equal numbers of moments with totals carried over (``plans.prefix``).
    """
    keys = list(keys)
    usable = intervals.select(*keys, F.col(start).cast("long").alias("_from"), F.col(end).cast("long").alias("_to")).where(F.col("_to") > F.col("_from")).dropna(subset=keys)
    events = usable.select(*keys, F.explode(F.array(F.struct(F.col("_from").alias("t"), F.lit(1).alias("delta"), F.lit(1).alias("starts")), F.struct(F.col("_to").alias("t"), F.lit(-1).alias("delta"), F.lit(0).alias("starts")))).alias("e")).select(*keys, "e.*")
    moments = durable(events.groupBy(*keys, "t").agg(F.sum("delta").alias("delta"), F.sum("starts").alias("starts")))
    active = running(with_blocks(moments, keys, "t", hot_rows), keys, ["t"], sums={"active": F.col("delta"), "started": F.col("starts")})
    opens = (F.col("active") > 0) & (F.col("active") == F.col("delta"))
    closes = (F.col("active") == 0) & (F.col("delta") < 0)
    # started counts the intervals up to now; before the opening event it counted those of earlier periods
    edges = active.where(opens | closes).select(*keys, "block", "t", "started", opens.alias("opens"), (F.col("started") - F.col("starts")).alias("earlier"))
    # every edge sees the latest opening (own or earlier) and the latest closing before it
    traced = running(edges, keys, ["t"], maxima={
        "opening": F.when(F.col("opens"), F.struct("t", "earlier")),
        "closing": F.when(~F.col("opens"), F.col("t")),
    })
    period = F.when(~F.col("opens"), F.struct(F.lit("period").alias("kind"), F.col("opening.t").alias("from_us"), F.col("t").alias("to_us"), (F.col("started") - F.col("opening.earlier")).alias("n")))
    gap = F.when(F.col("opens") & F.col("closing").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("closing").alias("from_us"), F.col("t").alias("to_us"), F.lit(None).cast("long").alias("n")))
    return traced.select(*keys, F.coalesce(period, gap).alias("r")).where("r is not null").select(*keys, "r.*")
