"""One object for the operations of the service, over the tables of a folder.

Reading methods return data frames. Changing methods return their results row by row and put the new state into
``tables``, written out as a new version so that plans stay short; ``save`` writes changed tables to a folder. There
is one writer per folder.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilframe.functions import luhn
from veilframe.operators import audit, classify, creation, entities, linkage, linked, lookup, permissions, present, pseudonymize, schema, search, tree
from veilframe.plans.durable import durable
from veilframe.sources.tables import table, write

NAMES = ("pseudonym_domain", "pseudonym", "project", "entity_type", "entity_instance", "audit_event")


@dataclass
class Linkage:
    """What creating instances needs in order to link them: ``fields`` turns (``id``, ``data``, ...) into a table with the
    ``columns`` of the rules; ``index`` holds the tokens of what is there and grows with what is created."""

    rules: Sequence[linkage.Rule]
    columns: Mapping[str, str]
    fields: Callable[[DataFrame], DataFrame]
    index: DataFrame
    config: linkage.Config = linkage.Config()


class Engine:
    def __init__(self, spark: SparkSession, folder: str, as_of: Column | None = None, names: Sequence[str] = NAMES) -> None:
        self.spark, self.folder = spark, folder
        self.as_of = as_of if as_of is not None else F.current_timestamp()
        self.tables: dict[str, DataFrame] = {n: table(spark, folder, n) for n in names}
        self.changed: set[str] = set()

    def _set(self, name: str, rows: DataFrame) -> None:
        self.tables[name] = durable(rows)
        self.changed.add(name)

    def save(self, folder: str) -> None:
        """Writes changed tables to another folder (a table can't be written over while it is read)."""
        for name in sorted(self.changed):
            write(self.tables[name], folder, name)
        self.changed.clear()

    @property
    def domains(self) -> DataFrame:
        return self.tables["pseudonym_domain"]

    @property
    def pseudonyms(self) -> DataFrame:
        return self.tables["pseudonym"]

    @property
    def instances(self) -> DataFrame:
        return self.tables["entity_instance"]

    @property
    def types(self) -> DataFrame:
        return self.tables["entity_type"]

    @property
    def projects(self) -> DataFrame:
        return self.tables["project"]

    # pseudonyms

    def create_pseudonyms(self, requests: DataFrame, add_prefix: bool = True) -> DataFrame:
        """Creates a batch (``request``, ``identifier``, ``idtype``, ``domainid``; optional ``pseudonym`` of the caller's
        own, ``given_from``, ``given_to``, ``period``) by the settings of each domain: validity within the domain's,
        collisions of drawn pseudonyms drawn again, counters advanced. Returns ``request``, ``pseudonym``, ``status``."""
        asked = requests.withColumnRenamed("pseudonym", "given") if "pseudonym" in requests.columns else requests
        results, domains = creation.create(asked, self.domains, self.pseudonyms, self.as_of, add_prefix)
        top = self.pseudonyms.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        rows = pseudonymize.numbered(results.where(F.col("status") == classify.SUCCESS), ["request"], top, "id")
        self._set("pseudonym", self.pseudonyms.unionByName(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.pseudonyms.schema])))
        self._set("pseudonym_domain", domains)
        return results.select("request", "pseudonym", "status")

    def complete_update(self, changes: DataFrame) -> DataFrame:
        """Updates of held pseudonyms (``id``, ``new_...`` values; null keeps the old): one whose identifier, type or
        domain changes is made anew by its domain, unless ``new_pseudonym`` brings one. Returns ``id``, ``pseudonym``."""
        held = self.pseudonyms
        made = lambda rows: durable(pseudonymize.by_domain(rows, self.domains, "psn", "id"))
        state = durable(classify.complete(changes, held, made))
        touched = state.join(changes.select("id").distinct(), "id", "left_semi")
        before = held.select("id", F.struct("identifier", "idtype", "domainid").alias("_old"))
        moved = touched.join(before, "id").where(F.struct("identifier", "idtype", "domainid") != F.col("_old"))
        self._set("pseudonym_domain", pseudonymize.advanced(self.domains, moved.select("domainid")))
        self._set("pseudonym", state)
        return touched.select("id", "pseudonym")

    def read_pseudonyms(self, domain_id: int, most: int = 50_000) -> DataFrame:
        return lookup.export(self.pseudonyms, domain_id, most)

    def get_pseudonyms(self, requests: DataFrame) -> DataFrame:
        """By identifier and type, by pseudonym, or by both: ``request`` and the rows found."""
        return lookup.dispatch(requests, self.pseudonyms).join(self.pseudonyms, "id")

    def update_pseudonyms(self, changes: DataFrame) -> DataFrame:
        flags, state = classify.update(changes, self.pseudonyms)
        self._set("pseudonym", state)
        return flags

    def delete_pseudonyms(self, requests: DataFrame) -> DataFrame:
        flags, state = classify.delete(requests, self.pseudonyms)
        self._set("pseudonym", state)
        return flags

    def validate_pseudonyms(self, rows: DataFrame, domain_id: int) -> DataFrame:
        """``rows`` (``psn``) with whether the check digit fits the domain's algorithm."""
        d = self.domains.where(F.col("id") == domain_id).select("algorithm", "alphabet", "prefix").first()
        return rows.withColumn("valid", luhn.valid(F.col("psn"), F.lit(d.prefix), luhn.check_alphabet(d.algorithm, d.alphabet)))

    def linked_pseudonyms(self, source: str, target: str, start: Column) -> DataFrame:
        """Pairs of source and target rows along the way between two domains; ``start`` chooses the source rows."""
        rows = self.domains.select("id", "name", "superdomainid").collect()  # configuration
        way = tree.path_names([tuple(r) for r in rows], source, target)
        if not way:
            return linked.linked(self.pseudonyms, F.lit(False), 0, -1)
        return linked.linked(self.pseudonyms, start, len(way) - 1, {r.name: r.id for r in rows}[target])

    def search_pseudonyms(self, query: str, domain_id: int, most: int = 30) -> tuple[DataFrame, bool]:
        return search.truncated(search.pseudonyms(self.pseudonyms, query, domain_id, self.as_of.cast("timestamp_ntz")), most)

    # domains

    def create_domains(self, requests: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
        """Creates domains (``request``, ``name``, ``prefix``, ``parent`` and given properties) with inheritance."""
        results = durable(entities.create_domains(requests, self.domains))
        fresh = results.where("status = 'created'")
        full = tree.inherit_at_creation(fresh.drop("request", "status"), self.domains, dict(defaults)).join(fresh.select("name", "prefix", "request"), "name")
        top = self.domains.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        rows = pseudonymize.numbered(full, ["request"], top, "id").withColumn("superdomainid", F.col("parent"))
        self._set("pseudonym_domain", self.domains.unionByName(rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.domains.schema])))
        return results.select("request", "status")

    def update_domain(self, domain_id: int, **values: Any) -> None:
        """Sets properties of a domain and hands them on to the domains below that inherit them; pseudonyms whose
        validity is inherited take over that of their domain."""
        domains = entities.set_domain(self.domains, domain_id, **values)
        for name, value in values.items():
            if f"{name}inherited" in domains.columns:
                effective = tree.cascade(self.domains, name, {domain_id: value}).withColumnRenamed("value", f"_{name}")
                domains = domains.join(effective, "id", "left").withColumn(name, F.coalesce(f"_{name}", name)).drop(f"_{name}")
        self._set("pseudonym_domain", domains.select(*self.domains.columns))
        if {"validfrom", "validto"} & set(values):
            self._set("pseudonym", tree.inherited_validity(self.pseudonyms, self.domains))

    def delete_domain(self, name: str) -> None:
        """Deletes a domain with all below it, their pseudonyms and, if the table ``grant`` is held, their grants."""
        kept = tree.without(self.domains, name, **{t: self.tables[t] for t in ("pseudonym", "grant") if t in self.tables})
        self._set("pseudonym_domain", kept.pop("domains"))
        for label, rows in kept.items():
            self._set(label, rows)

    def new_salt(self, domain_id: int, length: int = 32) -> str:
        salt = luhn.generate_salt(length)
        self._set("pseudonym_domain", entities.set_domain(self.domains, domain_id, salt=salt, saltlength=length))
        return salt

    def domain_attribute(self, name: str, complete_view: bool = False) -> DataFrame:
        return present.attribute(self.domains, name, complete_view)

    def domain_subtree(self, name: str) -> DataFrame:
        return tree.subtree(self.domains, name)

    def domain_hierarchy(self) -> DataFrame:
        return tree.hierarchy(self.domains)

    def search_domains(self, query: str, visible: DataFrame | None = None, most: int = 20) -> DataFrame:
        return search.domains(self.domains, query, visible, most)

    # entities

    def create_instances(self, requests: DataFrame, link: Linkage | None = None, idtype: str = "entity-id") -> DataFrame:
        """Creates instances (``request``, project, type, ``data``) in one operation: documents that fit their type are
        linked to what is there (``link``, if given), stored unless an equal one is held, get a pseudonym of their uid
        (under ``idtype``) in the domain of their type, if it has one, and are indexed.

        Returns ``request``, ``status`` (created, duplicate, rejected; by linkage returned or conflict), ``id`` (new or
        existing) and ``pseudonym``.
        """
        fits = schema.validate(requests.withColumnRenamed("request", "id"), self.types).select(F.col("id").alias("request"), (F.size("errors") == 0).alias("_fits"))
        checked = entities.create_instances(requests, self.instances).join(fits, "request").withColumn("status", F.when(~F.col("_fits"), "rejected").otherwise(F.col("status")))
        if link is not None:
            # requests get ids of their own, below those of instances
            asked = linkage.tokens(link.fields(requests.select((-1 - F.col("request")).alias("id"), *[c for c in requests.columns if c != "request"])), link.rules, link.columns, link.config)
            gone = self.instances.where("is_deleted").select("id")
            actions = linkage.auto_link(requests.select((-1 - F.col("request")).alias("query")), linkage.find(asked, link.index, link.config, gone), link.config)
            linked_to = actions.where("action <> 'created'").select((-1 - F.col("query")).alias("request"), "action", F.col("id").alias("_linked"))
            checked = checked.join(linked_to, "request", "left").withColumn("_hit", F.col("action").isNotNull() & (F.col("status") == "created"))
            checked = checked.withColumn("status", F.when(F.col("_hit"), F.col("action")).otherwise(F.col("status"))).withColumn("existing", F.when(F.col("_hit"), F.col("_linked")).otherwise(F.col("existing"))).drop("action", "_linked", "_hit")
        results = durable(checked.drop("_fits"))
        top = self.instances.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        fresh = durable(pseudonymize.numbered(results.where("status = 'created'").withColumn("instance_uid", F.expr("uuid()")), ["request"], top, "id"))
        rows = fresh.withColumn("is_deleted", F.lit(False)).withColumn("created_at", self.as_of).withColumn("updated_at", self.as_of).withColumn("data_sha256", F.sha2("data", 256))
        self._set("entity_instance", self.instances.unionByName(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.instances.schema])))
        homes = self.types.where("associated_domain_id is not null").select(F.col("id").alias("entity_type_id"), F.col("associated_domain_id").alias("domainid"))
        asks = fresh.join(homes, "entity_type_id").select("request", F.col("instance_uid").alias("identifier"), F.lit(idtype).alias("idtype"), "domainid")
        named = self.create_pseudonyms(asks).where(F.col("status") == classify.SUCCESS).select("request", "pseudonym")
        if link is not None:
            new = linkage.tokens(link.fields(fresh.select("id", "project_id", "entity_type_id", "data")), link.rules, link.columns, link.config)
            link.index = durable(linkage.rebuild_index(link.index, linkage.deduplicated(new, link.rules).select(*link.index.columns)))
        return results.join(fresh.select("request", F.col("id").alias("_new")), "request", "left").join(named, "request", "left").select("request", "status", F.coalesce("_new", "existing").alias("id"), "pseudonym")

    def update_instances(self, changes: DataFrame) -> DataFrame:
        flags, state = entities.update_instances(changes, self.instances, self.as_of)
        self._set("entity_instance", state)
        return flags

    def delete_instances(self, ids: DataFrame) -> None:
        self._set("entity_instance", entities.delete_instances(ids, self.instances, self.as_of))

    def get_instances(self, requests: DataFrame) -> DataFrame:
        return lookup.instance_by_any(requests, self.instances)

    def search_instances(self, query: str, type_id: int | None = None, most: int = 20) -> DataFrame:
        return search.instances(self.instances, query, type_id, most)

    def instance_pseudonyms(self, instances: DataFrame, domain: str, idtype: str, most: int | None = 20) -> DataFrame:
        return linked.of_instances(instances, self.pseudonyms, self.domains, domain, idtype, most)

    def record_linkage(self, queries: DataFrame, records: DataFrame, rules: Sequence[linkage.Rule], columns: Mapping[str, str], config: linkage.Config = linkage.Config(), deleted: DataFrame | None = None) -> DataFrame:
        """Candidates of the query records among ``records``, scored and ranked."""
        index = linkage.deduplicated(linkage.tokens(records, rules, columns, config), rules)
        return linkage.find(linkage.tokens(queries, rules, columns, config), index, config, deleted)

    # projects, types, permissions, audit, maintenance

    def running_projects(self) -> DataFrame:
        return entities.running_projects(self.projects, self.as_of)

    def end_projects(self, ids: DataFrame) -> None:
        self._set("project", entities.end_projects(self.projects, ids, self.as_of))

    def deprecate_types(self, ids: DataFrame) -> DataFrame:
        done, state = entities.deprecate_types(self.types, ids, entities.type_use(self.types, self.instances))
        self._set("entity_type", state)
        return done

    def search_types(self, query: str, project_id: int | None) -> DataFrame:
        return search.types(self.types, query, project_id)

    def allowed(self, requests: DataFrame, grants: DataFrame) -> DataFrame:
        return permissions.allowed(requests, grants, self.as_of)

    def record_audit(self, requests: DataFrame) -> None:
        """Appends requests to the audit trail."""
        rows = audit.build(requests)
        held = self.tables["audit_event"]
        top = held.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        numbered = rows.withColumn("id", F.lit(top) + 1 + F.monotonically_increasing_id())
        self._set("audit_event", held.unionByName(numbered.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in held.schema])))

    def retain_audit(self, days: int = 3650) -> None:
        self._set("audit_event", audit.retained(self.tables["audit_event"], self.as_of.cast("timestamp_ntz"), days))

    def metrics(self) -> DataFrame:
        return lookup.table_metrics(self.tables)

    def clear(self, name: str) -> None:
        self._set(name, entities.emptied(self.tables[name]))
