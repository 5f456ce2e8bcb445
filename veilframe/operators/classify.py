"""Batches of creations, updates and deletions against what is held, row by row classified."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from veilframe.plans.durable import durable
from veilframe.plans.skew import HOT_ROWS, mark_first

SUCCESS, SAME_IDENTIFIER, SAME_PSEUDONYM = "success", "duplicate identifier", "duplicate pseudonym"
FULL_KEY = ["identifier", "idtype", "pseudonym", "domainid"]


#: Up to so many requests are broadcast to the scan of what is held (about 100 bytes each, so 20 MB at most).
FEW_REQUESTS = 200_000


def near(held: DataFrame, requests: DataFrame, few: int = FEW_REQUESTS) -> DataFrame:
    """The held rows (full key) that share identifier and type, or pseudonym, with a request of their domain.

    The requests are counted: few of them are broadcast, so that a long history is only scanned and never shuffled;
    beyond ``few`` the rows are left as they are, since then the classification's own joins are as cheap.
    """
    keys = requests.select(*FULL_KEY)
    if keys.limit(few + 1).count() > few:
        return held.select(*FULL_KEY)
    rows = held.select(*FULL_KEY)
    by_id, by_psn = ["domainid", "identifier", "idtype"], ["domainid", "pseudonym"]
    same_id = rows.join(F.broadcast(keys.select(*by_id).distinct()), by_id, "left_semi").select(*FULL_KEY)
    return same_id.unionByName(rows.join(F.broadcast(keys.select(*by_psn).distinct()), by_psn, "left_semi").select(*FULL_KEY))


def create(requests: DataFrame, held: DataFrame, multiple: bool | str = False, order: str = "request", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``requests`` (``request``, identifier, idtype, pseudonym, domainid) with ``status``.

    A request whose identifier and type the domain holds is a duplicate identifier (unless ``multiple``, which may name
    a boolean column of the requests), else one whose pseudonym the domain holds a duplicate pseudonym, else a success. Within a batch the first request (by
    ``order``) of an identifier, and then of a pseudonym, wins and later ones are duplicates likewise. Rows to append
    are those with success. Held keys are made distinct before they meet the batch, so a key held often adds nothing, and
    a key that a large part of the batch shares is salted.
    """
    ids = held.select("domainid", "identifier", "idtype").distinct().withColumn("_has_id", F.lit(True))
    psns = held.select("domainid", "pseudonym").distinct().withColumn("_has_psn", F.lit(True))
    marked = requests.join(ids, ["domainid", "identifier", "idtype"], "left").join(psns, ["domainid", "pseudonym"], "left")
    if multiple is True:
        marked = marked.withColumn("_same_id", F.lit(False))
    else:
        firsts = mark_first(marked, ["domainid", "identifier", "idtype"], order, "_first", hot_rows)
        several = F.coalesce(F.col(multiple), F.lit(False)) if multiple else F.lit(False)
        marked = firsts.withColumn("_same_id", (F.col("_has_id").isNotNull() | ~F.col("_first")) & ~several).drop("_first")
    marked = durable(marked)  # the rest reads it several times
    fresh = ~F.col("_same_id") & F.col("_has_psn").isNull()
    winners = mark_first(marked.where(fresh), ["domainid", "pseudonym"], order, "_wins", hot_rows)
    settled = marked.where(~fresh).withColumn("status", F.when(F.col("_same_id"), SAME_IDENTIFIER).otherwise(SAME_PSEUDONYM))
    decided = winners.withColumn("status", F.when(F.col("_wins"), SUCCESS).otherwise(SAME_PSEUDONYM))
    return settled.select(*requests.columns, "status").unionByName(decided.select(*requests.columns, "status"))


def outcome(results: DataFrame) -> DataFrame:
    """How many requests ended in each status."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def reply(results: DataFrame) -> int:
    """201 if all succeeded, 206 if some, 422 if none."""
    wins, total = results.agg(F.coalesce(F.sum((F.col("status") == SUCCESS).cast("int")), F.lit(0)), F.count(F.lit(1))).first()
    return 201 if wins == total and total else 206 if wins else 422


def update(changes: DataFrame, held: DataFrame, order: str = "request") -> tuple[DataFrame, DataFrame]:
    """Applies ``changes`` (``request``, domainid, old_identifier, old_idtype, old_pseudonym and new values) to ``held``.

    A change needs exactly one held row that fits what it names of the old values; then its values replace the old
    ones, nulls keeping them. Of several changes of one row the first counts. Returns (``request``, ``updated``) and
    the new state.
    """
    news = ["identifier", "idtype", "pseudonym", "validfrom", "validfrominherited", "validto", "validtoinherited"]
    keyed = changes.withColumn("_by_psn", F.col("old_pseudonym").isNotNull())
    by_psn = keyed.where("_by_psn").join(held.select("id", "domainid", F.col("pseudonym").alias("old_pseudonym"), F.col("identifier").alias("_i"), F.col("idtype").alias("_t")), ["domainid", "old_pseudonym"]).where("(old_identifier is null or old_identifier = _i) and (old_idtype is null or old_idtype = _t)").select("request", "id")
    by_id = keyed.where("not _by_psn").join(held.select("id", "domainid", F.col("identifier").alias("old_identifier"), F.col("idtype").alias("old_idtype")), ["domainid", "old_identifier", "old_idtype"]).select("request", "id")
    hits = by_psn.unionByName(by_id)
    unique = hits.groupBy("request").agg(F.count(F.lit(1)).alias("_n"), F.first("id").alias("id")).where("_n = 1").drop("_n")
    chosen = unique.groupBy("id").agg(F.min(order).alias("request"))
    flags = changes.select("request").join(chosen.select("request", F.lit(True).alias("_done")), "request", "left").select("request", F.coalesce("_done", F.lit(False)).alias("updated"))
    fresh = chosen.join(changes.select("request", *[F.col(f"new_{c}").alias(f"_{c}") for c in news if f"new_{c}" in changes.columns]), "request").drop("request")
    columns = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if f"_{c}" in fresh.columns else F.col(c) for c in held.columns]
    return flags, held.join(fresh, "id", "left").select(*columns)


def delete(requests: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletes held rows by full key. Returns (``request``, ``deleted``) and what remains."""
    known = held.select(*FULL_KEY).distinct().withColumn("_known", F.lit(True))
    flags = requests.join(known, FULL_KEY, "left").select("request", F.coalesce("_known", F.lit(False)).alias("deleted"))
    return flags, held.join(requests.select(*FULL_KEY).distinct(), FULL_KEY, "left_anti")


def may_update(old_psn, old_identifier, old_idtype, multiple):
    """Whether an update names its row: by the old pseudonym, or by identifier and type where these are unique."""
    return old_psn.isNotNull() | (old_identifier.isNotNull() & old_idtype.isNotNull() & ~multiple)


def create_with_retries(requests: DataFrame, held: DataFrame, draw: Callable[[DataFrame, int], DataFrame], attempts: int = 3) -> DataFrame:
    """Creation with random pseudonyms: ``draw`` adds pseudonyms to requests without one; requests whose pseudonym
    collides draw again, ``attempts`` times in all; what then still collides keeps its status.

    Each attempt is written out before it is classified, since drawing anew would change it.
    """
    done, waiting, known = None, requests, held.select(*FULL_KEY)
    for attempt in range(attempts):
        results = durable(create(durable(draw(waiting, attempt)), known))
        last = attempt == attempts - 1
        settled = results if last else results.where(F.col("status") != SAME_PSEUDONYM)
        done = settled if done is None else done.unionByName(settled)
        waiting = results.where(F.col("status") == SAME_PSEUDONYM).select(*requests.columns)
        if last or waiting.isEmpty():
            break
        known = known.unionByName(results.where(F.col("status") == SUCCESS).select(*FULL_KEY))
    return done


def complete(changes: DataFrame, held: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Held rows after complete updates (``id`` and new identifier, idtype, domainid, validity; null keeps the old).

    A row whose identifier, type or domain changes gets a new pseudonym from ``make`` (which adds ``psn`` to rows with
    identifier, idtype and domainid), unless the change brings one of its own in ``new_pseudonym``.
    """
    news = [c[4:] for c in changes.columns if c.startswith("new_")]
    joined = held.join(changes, "id")
    value = lambda c: F.coalesce(F.col(f"new_{c}"), F.col(c)) if c in news else F.col(c)
    key = ["identifier", "idtype", "domainid"]
    moved = F.lit(False)
    for c in key:
        moved = moved | ~value(c).eqNullSafe(F.col(c))
    own = F.col("new_pseudonym") if "new_pseudonym" in news else F.lit(None).cast("string")
    changed = joined.select("id", *[value(c).alias(c) for c in held.columns if c not in ("id", "pseudonym")], F.col("pseudonym").alias("_old"), own.alias("_own"), moved.alias("_moved"))
    made = make(changed)
    fresh = made.withColumn("pseudonym", F.coalesce("_own", F.when(F.col("_moved"), F.col("psn")).otherwise(F.col("_old")))).select(*held.columns)
    return held.join(changes.select("id").distinct(), "id", "left_anti").unionByName(fresh)
