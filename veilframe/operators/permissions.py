"""Time-bounded grants: what is allowed, bounded delegation, replacing and bulk changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilframe.functions.validity import valid_at
from veilframe.plans.skew import mark_first

KEY = ["subject_id", "resource_type", "resource_id", "action"]
#: The actions of the groups of rights, by resource type.
ACTIONS: dict[str, list[str]] = {
    "DOMAIN": ["domain:delete", "domain:read", "domain:read-salt", "domain:read-subtree", "domain:update", "domain:update-complete", "domain:update-salt", "domain:manage-permissions", "pseudonym:create", "pseudonym:create-batch", "pseudonym:delete", "pseudonym:delete-batch", "pseudonym:read", "pseudonym:read-batch", "pseudonym:update", "pseudonym:update-complete", "pseudonym:update-batch", "pseudonym:link", "pseudonym:search", "complete-view"],
    "PROJECT": ["project:read", "project:update", "project:delete", "project:manage-permissions", "image:create", "image:read", "image:update", "image:delete", "type:create", "type:read", "type:update", "type:delete", "type:search", "instance:create", "instance:read", "instance:update", "instance:delete", "instance:search", "instance:record-linkage", "instance:list-pseudonyms"],
    "GLOBAL": ["domain:create", "domain:create-complete", "domain:list-all", "domain:search", "project:create", "project:list-all", "base-type:create", "base-type:read", "base-type:search", "roles:delete", "table:delete", "table:read-storage", "global:manage-permissions"],
}
MANAGE = {"DOMAIN": "domain:manage-permissions", "PROJECT": "project:manage-permissions", "GLOBAL": "global:manage-permissions"}
DEFAULT_DAYS = 3650


def catalogue(spark: SparkSession, actions: Mapping[str, Sequence[str]] = ACTIONS) -> DataFrame:
    """Every configured action with its resource type."""
    return spark.createDataFrame([(t, a) for t, some in actions.items() for a in some], "resource_type string, action string")


def effective(grants: DataFrame, as_of: Column) -> DataFrame:
    """Grants that allow something at ``as_of``."""
    return grants.where((F.col("decision") == "ALLOW") & valid_at(F.col("valid_from"), F.col("valid_to"), as_of))


def allowed_actions(grants: DataFrame, as_of: Column) -> DataFrame:
    """Different (subject, type, id, action) allowed at ``as_of``, ordered."""
    return effective(grants, as_of).select(*KEY).distinct().orderBy(*KEY)


def allowed(requests: DataFrame, grants: DataFrame, as_of: Column) -> DataFrame:
    """``requests`` with whether their action is allowed: one join with the distinct effective grants."""
    now = effective(grants, as_of).select(*KEY).distinct().withColumn("_ok", F.lit(True))
    return requests.join(now, KEY, "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_ok")


def delegable(requests: DataFrame, grants: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    """``requests`` (``request``, ``requester``, resource and action) with ``allowed``: the action belongs to the
    resource's group, and the requester may manage the resource's permissions and holds the action itself."""
    now = effective(grants, as_of).select(F.col("subject_id").alias("requester"), "resource_type", "resource_id", "action").distinct()
    holds = now.withColumn("_holds", F.lit(True))
    manage = F.create_map(*[F.lit(x) for pair in MANAGE.items() for x in pair])
    manages = now.where(F.col("action") == F.element_at(manage, F.col("resource_type"))).drop("action").withColumn("_manages", F.lit(True))
    belongs = actions.select("resource_type", "action").distinct().withColumn("_belongs", F.lit(True))
    joined = requests.join(belongs, ["resource_type", "action"], "left").join(manages, ["requester", "resource_type", "resource_id"], "left").join(holds, ["requester", "resource_type", "resource_id", "action"], "left")
    return joined.select(*requests.columns, (F.col("_belongs").isNotNull() & F.col("_manages").isNotNull() & F.col("_holds").isNotNull()).alias("allowed"))


def create(requests: DataFrame, grants: DataFrame, as_of: Column, creator: str = "UNKNOWN") -> tuple[DataFrame, DataFrame]:
    """New grants: (``request``, ``status``) and the rows to append. Held or repeated ones are duplicates (the first
    request wins); missing bounds become ``as_of`` and ten years after it."""
    known = grants.select(*KEY).distinct().withColumn("_known", F.lit(True))
    firsts = mark_first(requests, KEY, "request", "_first")
    marked = firsts.join(known, KEY, "left").withColumn("status", F.when(F.col("_known").isNotNull() | ~F.col("_first"), "duplicate").otherwise("success"))
    start = F.coalesce("valid_from", as_of)
    rows = marked.where("status = 'success'").select(*KEY, F.lit("ALLOW").alias("decision"), start.alias("valid_from"), F.coalesce(F.col("valid_to"), start + F.make_dt_interval(F.lit(DEFAULT_DAYS))).alias("valid_to"), as_of.alias("created_at"), F.lit(creator).alias("created_by"))
    return marked.select("request", "status"), rows


def delete(requests: DataFrame, grants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removes grants by key: (``request``, ``deleted``) and what remains."""
    known = grants.select(*KEY).distinct().withColumn("_known", F.lit(True))
    return requests.join(known, KEY, "left").select("request", F.coalesce("_known", F.lit(False)).alias("deleted")), grants.join(requests.select(*KEY).distinct(), KEY, "left_anti")


def update(changes: DataFrame, grants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New bounds or decisions (``request``, key, ``valid_from``, ``valid_to``, ``decision``; null keeps the old) for held
    grants: (``request``, ``updated``) and the new state. Of several changes of one grant the first counts; a grant
    held several times changes everywhere; an end before the start is moved to it."""
    news = [c for c in ("valid_from", "valid_to", "decision") if c in changes.columns]
    first = changes.groupBy(*KEY).agg(F.min(F.struct("request", *news)).alias("_f"))
    held = grants.select(*KEY).distinct()
    done = first.join(held, KEY, "left_semi").select(F.col("_f.request").alias("request"), F.lit(True).alias("_done"))
    flags = changes.select("request").join(done, "request", "left").select("request", F.coalesce("_done", F.lit(False)).alias("updated"))
    joined = grants.join(first, KEY, "left")
    for c in news:
        joined = joined.withColumn(c, F.coalesce(F.col(f"_f.{c}"), F.col(c)))
    return flags, joined.withColumn("valid_to", F.greatest("valid_to", "valid_from")).select(*grants.columns)


def replace(grants: DataFrame, desired: DataFrame) -> DataFrame:
    """What has to change so that resources have just the desired actions: key and ``op`` insert or delete.

    Desired actions are trimmed, blank ones left out; subjects and resources not mentioned in ``desired`` stay.
    """
    wanted = desired.withColumn("action", F.trim("action")).where("action <> ''").select(*KEY).distinct()
    scope = desired.select("subject_id", "resource_type", "resource_id").distinct()
    current = grants.where("decision = 'ALLOW'").join(scope, ["subject_id", "resource_type", "resource_id"], "left_semi").select(*KEY).distinct()
    return wanted.join(current, KEY, "left_anti").withColumn("op", F.lit("insert")).unionByName(current.join(wanted, KEY, "left_anti").withColumn("op", F.lit("delete")))


def grant_group(subjects: DataFrame, actions: DataFrame) -> DataFrame:
    """The whole group of rights of each (``subject_id``, ``resource_type``, ``resource_id``), by the resource type."""
    return subjects.join(actions.select("resource_type", "action"), "resource_type").select(*KEY)


def revoke(grants: DataFrame, gone: DataFrame) -> DataFrame:
    """Grants without those that share all columns of ``gone`` (subjects, resources or both)."""
    return grants.join(gone.distinct(), gone.columns, "left_anti")


def accessible(projects: DataFrame, grants: DataFrame, subject: str, as_of: Column) -> DataFrame:
    """Projects on which the subject may do anything."""
    ids = effective(grants, as_of).where((F.col("subject_id") == subject) & (F.col("resource_type") == "PROJECT")).select(F.col("resource_id").alias("id")).distinct()
    return projects.join(ids, "id", "left_semi")


def labelled(grants: DataFrame, domains: DataFrame, projects: DataFrame) -> DataFrame:
    """Grants with the ``label`` of their resource: a domain's name, a project's abbreviation, null for global ones."""
    d = domains.select(F.lit("DOMAIN").alias("resource_type"), F.col("id").alias("resource_id"), F.col("name").alias("_d"))
    p = projects.select(F.lit("PROJECT").alias("resource_type"), F.col("id").alias("resource_id"), F.col("abbreviation").alias("_p"))
    return grants.join(d, ["resource_type", "resource_id"], "left").join(p, ["resource_type", "resource_id"], "left").withColumn("label", F.coalesce("_d", "_p")).drop("_d", "_p")


def resource_ids(requests: DataFrame, domains: DataFrame, projects: DataFrame) -> DataFrame:
    """The inverse: ``requests`` (``resource_type``, ``label``) with ``resource_id``; 0 for global rights, null for
    an unknown label."""
    names = domains.select(F.lit("DOMAIN").alias("resource_type"), F.lower("name").alias("_l"), F.col("id").alias("_id")).unionByName(projects.select(F.lit("PROJECT").alias("resource_type"), F.lower("abbreviation").alias("_l"), F.col("id").alias("_id")))
    joined = requests.withColumn("_l", F.lower(F.trim("label"))).join(names, ["resource_type", "_l"], "left")
    return joined.select(*requests.columns, F.when(F.col("resource_type") == "GLOBAL", 0).otherwise(F.col("_id")).alias("resource_id"))


def checked(requests: DataFrame, actions: DataFrame) -> DataFrame:
    """``requests`` with the reason why a row can't be granted, null if it can; every row keeps its place."""
    belongs = actions.select("resource_type", "action").distinct().withColumn("_belongs", F.lit(True))
    joined = requests.join(belongs, ["resource_type", "action"], "left")
    reason = F.when(F.coalesce(F.trim("subject_id"), F.lit("")) == "", "no subject").when(~F.coalesce("resource_type", F.lit("")).isin(list(ACTIONS)), "no such resource type").when(F.col("_belongs").isNull(), "no such action").when((F.col("resource_type") != "GLOBAL") & F.col("resource_id").isNull(), "no resource")
    return joined.select(*requests.columns, reason.alias("reason"))
