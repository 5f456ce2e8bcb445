"""Entity instances, types, projects and algorithms: uniqueness, updates, use counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilframe.operators.lookup import json_equal_key
from veilframe.plans.skew import mark_first

SCOPE = ["project_id", "entity_type_id"]


def create_instances(requests: DataFrame, instances: DataFrame) -> DataFrame:
    """``requests`` (``request``, project, type, ``data``) with ``status`` and, for duplicates, the ``existing`` id.

    A document that a live instance of the project and type already holds, as equal JSON, is a duplicate; of equal
    requests the first is created. What is no JSON is rejected.
    """
    held = json_equal_key(instances.where("not is_deleted").select("id", *SCOPE, "data"), "data").groupBy(*SCOPE, "json_key").agg(F.min("id").alias("existing"))
    keyed = json_equal_key(requests, "data")
    marked = mark_first(keyed, [*SCOPE, "json_key"], "request", "_first").withColumn("_again", ~F.col("_first")).join(held, [*SCOPE, "json_key"], "left")
    status = F.when(F.col("json_key").isNull(), "rejected").when(F.col("existing").isNotNull() | F.col("_again"), "duplicate").otherwise("created")
    return marked.select(*requests.columns, status.alias("status"), "existing")


def update_instances(changes: DataFrame, instances: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """New documents (``id``, ``data``) for live instances; (``id``, ``updated``) and the new state."""
    first = changes.groupBy("id").agg(F.first("data").alias("_data"))
    joined = instances.join(first, "id", "left")
    hit = F.col("_data").isNotNull() & ~F.col("is_deleted")
    state = joined.withColumn("data", F.when(hit, F.col("_data")).otherwise(F.col("data"))).withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at"))).drop("_data")
    flags = first.join(instances.where("not is_deleted").select("id", F.lit(True).alias("_live")), "id", "left").select("id", F.coalesce("_live", F.lit(False)).alias("updated"))
    return flags, state.select(*instances.columns)


def delete_instances(ids: DataFrame, instances: DataFrame, as_of: Column) -> DataFrame:
    """The state with the given live instances marked as deleted; they keep their linkage tokens."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    joined = instances.join(gone, "id", "left")
    hit = F.col("_gone") & ~F.col("is_deleted")
    return joined.withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at"))).withColumn("is_deleted", F.coalesce(hit, F.lit(False)) | F.col("is_deleted")).select(*instances.columns)


def derived(instances: DataFrame) -> DataFrame:
    """The generated columns of an instance: SHA-256 of the stored text and the text's lexemes."""
    from veilframe.functions.fulltext import json_text, lexemes

    return instances.withColumn("data_sha256", F.sha2("data", 256)).withColumn("lexemes", F.array_sort(lexemes(json_text(F.col("data")))))


def type_use(types: DataFrame, instances: DataFrame) -> DataFrame:
    """``id`` and the number of instances of each type; a type in use can't be changed."""
    used = instances.groupBy(F.col("entity_type_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return types.select("id").join(used, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("instances"))


def project_use(projects: DataFrame, types: DataFrame, instances: DataFrame) -> DataFrame:
    """``id`` and the number of types plus instances of each project."""
    t = types.where("project_id is not null").groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("t"))
    i = instances.groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("i"))
    return projects.select("id").join(t, "id", "left").join(i, "id", "left").select("id", (F.coalesce("t", F.lit(0)) + F.coalesce("i", F.lit(0))).alias("uses"))


def deprecate_types(types: DataFrame, ids: DataFrame, use: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deprecates types that no instance uses: (``id``, ``done``) and the new state."""
    free = ids.select("id").distinct().join(use, "id", "left").select("id", (F.coalesce("instances", F.lit(0)) == 0).alias("done"))
    state = types.join(free, "id", "left").withColumn("is_deprecated", F.col("is_deprecated") | F.coalesce("done", F.lit(False))).select(*types.columns)
    return free.join(types.select("id"), "id", "left_semi"), state


def create_types(requests: DataFrame, types: DataFrame) -> DataFrame:
    """``requests`` (``request``, ``name``, ``project_id``) with ``status``: names are unique, case ignored, among the
    types of a project and, for base types, among those without one."""
    key = [F.lower("name").alias("_name"), F.coalesce("project_id", F.lit(-1)).alias("_project")]
    held = types.select(*key).distinct().withColumn("_held", F.lit(True))
    marked = requests.select("*", *key).join(held, ["_name", "_project"], "left")
    again = F.row_number().over(Window.partitionBy("_name", "_project").orderBy("request")) > 1
    return marked.withColumn("status", F.when(F.col("_held").isNotNull() | again, "duplicate").otherwise("created")).select(*requests.columns, "status")


def project_terms(start: Column, end: Column, as_of: Column, years: int = 10) -> tuple[Column, Column]:
    """Start and end of a new project: start defaults to now, end to ten years later, an end before the start to the
    start."""
    begin = F.coalesce(start, as_of)
    return begin, F.greatest(F.coalesce(end, begin + F.make_ym_interval(F.lit(years))), begin)


def update_projects(changes: DataFrame, projects: DataFrame, use: DataFrame) -> DataFrame:
    """Projects after changes (``id`` and new values, null keeps the old): of a project in use only name, end and
    description change; an end before the start is moved to it."""
    free = {"abbreviation", "start_date", "store_entities", "store_pseudonyms"}
    news = [c for c in changes.columns if c != "id"]
    joined = projects.join(changes.select("id", *[F.col(c).alias(f"_{c}") for c in news]), "id", "left").join(use, "id", "left")
    for c in news:
        usable = (F.coalesce("uses", F.lit(0)) == 0) if c in free else F.lit(True)
        joined = joined.withColumn(c, F.coalesce(F.when(usable, F.col(f"_{c}")), F.col(c)))
    return joined.withColumn("end_date", F.when(F.col("end_date") < F.col("start_date"), F.col("start_date")).otherwise(F.col("end_date"))).select(*projects.columns)


def end_projects(projects: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Soft deletion: the given projects end now, unless they ended before."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    return projects.join(gone, "id", "left").withColumn("end_date", F.when(F.col("_gone"), F.least(F.coalesce("end_date", as_of), as_of)).otherwise(F.col("end_date"))).select(*projects.columns)


def running_projects(projects: DataFrame, as_of: Column) -> DataFrame:
    return projects.where((F.col("start_date") <= as_of) & (F.col("end_date").isNull() | (F.col("end_date") > as_of)))


def get_or_create_algorithm(algorithms: DataFrame, wanted: Mapping[str, object]) -> tuple[DataFrame, bool]:
    """The stand-alone algorithm with these values: (table with it, whether it is new). Configuration, a few rows."""
    test = F.lit(True)
    for k, v in wanted.items():
        test = test & F.col(k).eqNullSafe(F.lit(v))
    if not algorithms.where(test).isEmpty():
        return algorithms, False
    new_id = (algorithms.agg(F.max("id")).first()[0] or 0) + 1
    row = algorithms.sparkSession.range(1).select(*[F.lit(new_id if f.name == "id" else wanted.get(f.name)).cast(f.dataType).alias(f.name) for f in algorithms.schema])
    return algorithms.unionByName(row), True


def update_algorithm(algorithms: DataFrame, algorithm_id: int, **values: object) -> tuple[DataFrame, bool]:
    """The table with values of one algorithm replaced (its counter among them) and whether the algorithm is there."""
    found = not algorithms.where(F.col("id") == algorithm_id).isEmpty()
    here = F.col("id") == algorithm_id
    return algorithms.select(*[F.when(here, F.lit(values[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in algorithms.schema]), found


def delete_algorithm(algorithms: DataFrame, algorithm_id: int) -> tuple[DataFrame, bool]:
    """The table without one algorithm and whether it was there."""
    return algorithms.where(F.col("id") != algorithm_id), not algorithms.where(F.col("id") == algorithm_id).isEmpty()


def create_domains(requests: DataFrame, domains: DataFrame) -> DataFrame:
    """``requests`` (``request``, ``name``) with ``status``; a name that exists, case ignored, is a duplicate."""
    held = domains.select(F.lower("name").alias("_name")).distinct().withColumn("_held", F.lit(True))
    again = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("request")) > 1
    return requests.withColumn("_name", F.lower("name")).join(held, "_name", "left").withColumn("status", F.when(F.col("_held").isNotNull() | again, "duplicate").otherwise("created")).drop("_name", "_held")


def with_labels(instances: DataFrame, projects: DataFrame, types: DataFrame) -> DataFrame:
    """Instances with the names of project and type."""
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    t = types.select(F.col("id").alias("entity_type_id"), F.col("name").alias("type_name"))
    return instances.join(p, "project_id", "left").join(t, "entity_type_id", "left")


def set_domain(domains: DataFrame, domain_id: int, **values: object) -> DataFrame:
    """Domains with some values of one replaced (counter, salt, name, ...); a given property is no longer inherited."""
    here = F.col("id") == domain_id
    flags = {f"{k}inherited": False for k in values if f"{k}inherited" in domains.columns}
    changed = {**values, **flags}
    return domains.select(*[F.when(here, F.lit(changed[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in changed else F.col(f.name) for f in domains.schema])


def domain_labels(domains: DataFrame) -> DataFrame:
    """Domains with the name of their parent."""
    parents = domains.select(F.col("id").alias("superdomainid"), F.col("name").alias("parent_name"))
    return domains.join(parents, "superdomainid", "left").select(*domains.columns, "parent_name")


#: What a project image may be.
IMAGE_TYPES, IMAGE_BYTES = ("image/png", "image/jpeg", "image/gif", "image/webp"), 5 * 1024 * 1024


def usable_images(images: DataFrame) -> DataFrame:
    """Images (``data`` binary, ``mime``) with the reason why one can't be stored, null if it can."""
    size = F.length("data")
    reason = F.when(F.col("data").isNull() | (size == 0), "empty").when(size > IMAGE_BYTES, "too large").when(~F.coalesce(F.lower("mime"), F.lit("")).isin(*IMAGE_TYPES), "wrong type")
    return images.withColumn("reason", reason)


def emptied(table: DataFrame) -> DataFrame:
    """A table without its rows, to be written over it."""
    return table.limit(0)
