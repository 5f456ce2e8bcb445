"""Record linkage: tokens, index, candidates, scores and the decision on creation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilframe.functions import normalize as N
from veilframe.functions.phonetics import encode
from veilframe.functions.pprl import Pprl, band_tokens, bloom_positions, dice, exact_token
from veilframe.operators.schema import kind_of, leaves
from veilframe.plans.durable import durable
from veilframe.plans.skew import HOT_ROWS, hot_groups

BLOCKING = ("block", "pprl_block")
#: Records of a kind that are ranked, and kinds that are met, by one task at a time.
TOGETHER = 1_000
TOKEN = ["id", "field_path", "tag", "token_type", "token_value", "weight"]


@dataclass(frozen=True)
class Rule:
    """How a field is turned into linkage tokens."""

    path: str
    kind: str = "string"
    tag: str = ""
    normalizers: tuple[str, ...] = ("trim", "lower", "collapseWhitespace")
    encoders: tuple[str, ...] = ()
    blocking: tuple[str, ...] = ("exact", "prefix4", "bloomBands")
    weight: float = 1.0


@dataclass(frozen=True)
class Config:
    """Linkage settings of an entity type."""

    enabled: bool = True
    private: bool = False
    pprl: Pprl | None = None
    min_score: float = 4.0
    min_normalized: float = 0.5
    bloom_min: float = 0.75
    #: Candidates per query that are scored at all (by votes), as the service does; None scores every candidate.
    limit: int | None = 250
    auto_link: bool = False
    on_match: str = "reject"
    extra: Mapping[str, Any] = field(default_factory=dict)


def resolve_config(project: Mapping[str, Any] | None, base: Mapping[str, Any] | None = None, secret: str = "") -> Config:
    """Settings of the project's definition, where it has none those of the base, else the defaults."""
    block = (project or {}).get("recordLinkage") or (base or {}).get("recordLinkage") or {}
    private = str(block.get("privacyMode", "plain")).lower() == "pprl"
    p = block.get("pprl") or {}
    pprl = Pprl(secret, p.get("method", "ngramBloomFilter"), p.get("n", 2), p.get("length", 1024), p.get("hashPositions", 10), p.get("bandSize", 32), p.get("exact", False)) if private else None
    return Config(block.get("enabled", True), private, pprl, block.get("minScore", 4.0), block.get("minNormalizedScore", 0.5), block.get("bloomMinSimilarity", 0.75), block.get("candidateLimit", 250), block.get("autoLinkOnCreate", False), block.get("onMatch", "reject"))


def resolve_rules(project: Mapping[str, Any], base: Mapping[str, Any] | None = None) -> list[Rule]:
    """A rule for each leaf that takes part in linkage: its own flag decides, else the base's. Defaults go by the
    base's leaf if there is one; tag and settings by its own, else the base's."""
    known, rules = leaves(base), []
    for path, own in leaves(project).items():
        parent = known.get(path)
        if not own.get("linkage", bool(parent and parent.get("linkage"))):
            continue
        source = parent or own
        kind = kind_of(source)
        rule: dict[str, Any] = {"path": path, "kind": kind, "tag": f"generic.{path.rsplit('.', 1)[-1]}"}
        if kind == "date":
            rule |= {"blocking": ("exact", "year", "yearMonth", "bloomBands"), "weight": 3.0, "normalizers": ()}
        tags = own.get("tags") if "tags" in own else (parent or {}).get("tags")
        if tags:
            rule["tag"] = tags[0]
        settings = own.get("linkageConfig") or (parent or {}).get("linkageConfig") or {}
        rule |= {k: tuple(settings[k]) for k in ("normalizers", "encoders", "blocking") if k in settings}
        rule |= {"weight": float(settings["weight"])} if "weight" in settings else {}
        rules.append(Rule(**rule))
    return rules


def values_at(data: str, path: str, repeatable: bool = False) -> Column:
    """The scalar texts under a dotted path of JSON text, as an array; a lone value is an array of one."""
    found = F.get_json_object(data, "$." + path)
    several = F.from_json(F.get_json_object(data, "$." + path.replace(".", "[*].") + "[*]"), "array<string>")
    return F.coalesce(several, F.array(found)) if repeatable else F.array(found)


def _token(rule: Rule, kind: str, value: Column, tag: Column | None = None) -> Column:
    return F.when(~N.blank(value), F.struct(F.lit(rule.path).alias("field_path"), (tag if tag is not None else F.lit(rule.tag)).alias("tag"), F.lit(kind).alias("token_type"), value.alias("token_value"), F.lit(rule.weight).alias("weight")))


def prepared(values: DataFrame, rule: Rule, column: str) -> Column:
    return N.iso_date(F.col(column)) if rule.kind == "date" else N.normalize(F.col(column), rule.normalizers)


def plain_tokens(rows: DataFrame, rule: Rule, column: str) -> DataFrame:
    """Tokens of one field (``id`` and ``column``): norm, one phonetic per encoder, and one block token per blocking;
    each different value is worked out once and joined back."""
    distinct = rows.select(F.col(column).alias("v")).where("v is not null").distinct()
    with_value = distinct.withColumn("n", prepared(distinct, rule, "v")).where("n is not null")
    for k, e in enumerate(rule.encoders):
        with_value = with_value.withColumn(f"e{k}", encode(e)(F.col("n")))
    codes = [F.col(f"e{k}") for k in range(len(rule.encoders))]
    tokens = [_token(rule, "norm", F.col("n")), *[_token(rule, "phonetic", c) for c in codes]]
    for block in rule.blocking:
        name = block.strip().lower()
        if name == "exact":
            tokens.append(_token(rule, "block", F.col("n")))
        elif name in ("prefix3", "prefix4", "prefix6"):
            tokens.append(_token(rule, "block", N.prefix_block(F.col("n"), int(name[-1]))))
        elif name == "phonetic":
            tokens += [_token(rule, "block", c) for c in codes]
        elif name in ("year", "yearmonth") and rule.kind == "date":
            tokens.append(_token(rule, "block", F.substring("n", 1, 4 if name == "year" else 7)))
    made = with_value.select("v", F.explode(F.array_compact(F.array(*tokens))).alias("t"))
    return rows.select("id", F.col(column).alias("v")).join(made, "v").select("id", "t.*")


def private_tokens(rows: DataFrame, rule: Rule, column: str, pprl: Pprl, project: int, kind: int) -> DataFrame:
    """Protected tokens of one field. Bloom filters are kept as set bits in ``bits`` (their token value is the bits
    joined by commas); phonetic codes are protected under a tag of their own."""
    p = pprl.floored()
    distinct = rows.select(F.col(column).alias("v")).where("v is not null").distinct()
    normal = distinct.withColumn("n", prepared(distinct, rule, "v")).where("n is not null").select("v", "n", F.lit(rule.tag).alias("tag"), F.lit(False).alias("encoded"))
    variants = [normal]
    for e in rule.encoders:
        variants.append(normal.select("v", encode(e)(F.col("n")).alias("n"), F.lit(f"{rule.tag}:encoder:{e.lower()}").alias("tag"), F.lit(True).alias("encoded")).where("n is not null"))
    every = reduce(DataFrame.unionByName, variants)
    names = {b.strip().lower() for b in rule.blocking}
    blocks = F.when(F.col("encoded"), F.lit("phonetic" in names)).otherwise(F.lit("exact" in names))
    project_c, kind_c = F.lit(project), F.lit(kind)
    exact = exact_token(p, project_c, kind_c, F.col("tag"), F.col("n"))
    if p.method.strip().lower() == "hmacexact":
        made = every.select("v", F.array(_token(rule, "pprl_exact", exact, F.col("tag")), F.when(blocks, _token(rule, "pprl_block", exact, F.col("tag")))).alias("t"), F.lit(None).cast("array<int>").alias("bits"))
    else:
        bloomed = every.withColumn("bits", bloom_positions(p, project_c, kind_c, F.col("tag"), F.col("n")))
        tokens = [F.array(_token(rule, "pprl_bloom", F.array_join(F.col("bits").cast("array<string>"), ","), F.col("tag")))]
        if "bloombands" in names:
            bands = F.transform(band_tokens(p, project_c, kind_c, F.col("tag"), F.col("bits")), lambda b: _token(rule, "pprl_block", b, F.col("tag")))
            tokens.append(F.when(F.col("encoded"), F.array().cast(T_TOKENS)).otherwise(bands.cast(T_TOKENS)))
        if p.exact:
            tokens.append(F.array(_token(rule, "pprl_exact", exact, F.col("tag"))))
        tokens.append(F.array(F.when(blocks, _token(rule, "pprl_block", exact, F.col("tag")))))
        made = bloomed.select("v", F.concat(*[t.cast(T_TOKENS) for t in tokens]).alias("t"), "bits")
    exploded = made.select("v", F.explode(F.array_compact("t")).alias("t"), "bits").select("v", "t.*", F.when(F.col("t.token_type") == "pprl_bloom", F.col("bits")).alias("bits"))
    return rows.select("id", F.col(column).alias("v")).join(exploded, "v").drop("v")


T_TOKENS = "array<struct<field_path:string,tag:string,token_type:string,token_value:string,weight:double>>"


def tokens(records: DataFrame, rules: Sequence[Rule], columns: Mapping[str, str], config: Config = Config(), project: int = 1, kind: int = 1) -> DataFrame:
    """All tokens of ``records`` (``id`` and, per rule path, a column of texts); none if linkage is off."""
    build = (lambda r: private_tokens(records, r, columns[r.path], config.pprl, project, kind)) if config.private else (lambda r: plain_tokens(records, r, columns[r.path]).withColumn("bits", F.lit(None).cast("array<int>")))
    made = reduce(DataFrame.unionByName, [build(r) for r in rules])
    return made if config.enabled else made.limit(0)


def deduplicated(made: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One token per record, tag, type and value; of several the one of the earlier rule is kept."""
    order = F.array_position(F.array(*[F.lit(r.path) for r in rules]), F.col("field_path"))
    rank = F.row_number().over(Window.partitionBy("id", "tag", "token_type", "token_value").orderBy(order))
    return made.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def rebuild_index(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index with all tokens of the records in ``fresh`` replaced."""
    return index.join(fresh.select("id").distinct(), "id", "left_anti").unionByName(fresh.select(*index.columns))


def without_instances(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the tokens of the given ids."""
    return index.join(gone.select("id").distinct(), "id", "left_anti")


def candidates(queries: DataFrame, index: DataFrame, limit: int | None = 250, most_in_block: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``query``, ``id`` and ``votes``: records that share blocking tokens with a query record, most first.

    An equi-join of tokens, never a list of conditions; both sides are made distinct first and a query never meets
    itself. A block that very many records share is salted on the index side. ``limit`` per query is the feature's
    own, ties by id; ``most_in_block`` (off by default) leaves out blocks larger than that.
    """
    key = ["tag", "token_type", "token_value"]
    asked = queries.where(F.col("token_type").isin(*BLOCKING)).select(F.col("id").alias("query"), *key).distinct()
    held = index.where(F.col("token_type").isin(*BLOCKING)).select("id", *key).distinct()
    if most_in_block is not None:
        held = held.join(held.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_in_block), key, "left_semi")
    hot = hot_groups(held.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key, rows=hot_rows)
    salts = F.coalesce("salts", F.lit(1))
    held = held.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).drop("salts")
    asked = asked.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    votes = asked.join(held, [*key, "salt"]).where("query <> id").groupBy("query", "id").agg(F.count(F.lit(1)).alias("votes"))
    if limit is None:
        return votes
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("votes").desc(), "id"))
    return votes.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def best_possible(query_tokens: DataFrame) -> DataFrame:
    """``query`` and ``possible``: the greatest weight of each field, summed."""
    scoring = query_tokens.where(~F.col("token_type").isin(*BLOCKING))
    return scoring.groupBy(F.col("id").alias("query"), "field_path").agg(F.max("weight").alias("w")).groupBy("query").agg(F.sum("w").alias("possible"))


def contribution(config: Config) -> Column:
    """What a pair of comparable tokens adds: the weight for equal normal or exact values, three quarters for equal
    phonetic codes, weight times similarity for Bloom filters that are similar enough."""
    equal = F.col("q.token_value") == F.col("c.token_value")
    kind, weight, alike = F.col("q.token_type"), F.col("q.weight"), F.col("similarity")
    return F.when(kind.isin("norm", "pprl_exact") & equal, weight).when((kind == "phonetic") & equal, 0.75 * weight).when((kind == "pprl_bloom") & (alike >= config.bloom_min), weight * alike).otherwise(0.0)


def _asking(query_tokens: DataFrame) -> DataFrame:
    return query_tokens.where(~F.col("token_type").isin(*BLOCKING)).select(F.col("id").alias("query"), F.struct("token_type", "token_value", "weight", "bits").alias("q"), "field_path", "tag")


def _answering(index: DataFrame) -> DataFrame:
    return index.where(~F.col("token_type").isin(*BLOCKING)).select("id", F.struct("token_type", "token_value", "bits").alias("c"), "field_path", "tag")


def _best(wide: DataFrame, config: Config) -> DataFrame:
    """``query``, ``id``, ``field_path`` and the best contribution ``b`` (part, text) of rows of comparable tokens."""
    wide = wide.where("q.token_value = c.token_value or q.token_type = 'pprl_bloom'")
    wide = wide.withColumn("similarity", F.when(F.col("q.token_type") == "pprl_bloom", dice(F.col("q.bits"), F.col("c.bits")))).withColumn("part", contribution(config)).where("part > 0")
    text = F.concat(F.col("field_path"), F.lit(" ["), F.col("tag"), F.lit(", "), F.upper("q.token_type"), F.lit("]"), F.when(F.col("similarity").isNotNull(), F.format_string(" similarity = %.3f", F.col("similarity"))).otherwise(F.lit("")))
    return wide.withColumn("text", text).groupBy("query", "id", "field_path").agg(F.max(F.struct("part", "text")).alias("b"))


def scored(pairs: DataFrame, query_tokens: DataFrame, index: DataFrame, config: Config = Config()) -> DataFrame:
    """``query``, ``id``, ``score``, ``normalized`` and ``matched_on`` of candidate pairs.

    Tokens are comparable under equal field path, tag and type. The best contribution of each field counts; its tokens
    explain the match. Equal-value kinds join on the value as well, so only Bloom filters compare differing ones.
    """
    wide = pairs.select("query", "id").join(_asking(query_tokens), "query").join(_answering(index), ["id", "field_path", "tag"])
    best = _best(wide.where("q.token_type = c.token_type"), config)
    totals = best.groupBy("query", "id").agg(F.sum("b.part").alias("score"), F.array_sort(F.collect_list("b.text")).alias("matched_on"))
    return totals.join(best_possible(query_tokens), "query").where("possible > 0").select("query", "id", "score", (F.col("score") / F.col("possible")).alias("normalized"), "matched_on")


def _profiled(tokens: DataFrame, together: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records by what they hold: ``id``, ``kind`` and ``salt`` of each record; the tags of each kind (``kind``, ``tag``,
    ``profile``, and ``n``, its records); each profile's tokens, with the profile as ``id``.

    A profile is the set of a record's tokens under one tag, a kind the set of its profiles; both are numbered. Sets are
    compared by digests of 128 bits. Records of a kind are dealt to one salt for each ``together`` of them.
    """
    token = F.unhex(F.md5(F.to_json(F.struct("field_path", "tag", "token_type", "token_value", "weight"))))
    digest = lambda c: F.unhex(F.md5(F.array_join(F.transform(F.array_sort(F.collect_set(c)), F.hex), "")))
    tagged = durable(tokens.groupBy("id", "tag").agg(digest(token).alias("held")))
    profiles = durable(tagged.groupBy("tag", "held").agg(F.min("id").alias("first")).withColumn("profile", F.monotonically_increasing_id()))
    kinds = durable(tagged.groupBy("id").agg(digest("held").alias("all")))
    kind = durable(kinds.groupBy("all").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("kind", F.monotonically_increasing_id()))
    held = kind.join(tagged.withColumnRenamed("id", "first"), "first").join(profiles.select("tag", "held", "profile"), ["tag", "held"])
    made = tokens.join(profiles.select(F.col("first").alias("id"), "tag", "profile"), ["id", "tag"]).drop("id").withColumnRenamed("profile", "id")
    rows = kinds.join(kind.select("all", "kind", "n"), "all").select("id", "kind", F.pmod(F.xxhash64("id"), _salts(together)).cast("int").alias("salt"))
    return durable(rows), durable(held.select("kind", "tag", "profile", "n")), durable(made.dropDuplicates(["id", *TOKEN[1:]]))


def _salts(together: int) -> Column:
    return F.ceil(F.col("n") / F.lit(together)).cast("int")


def _areas(pairs: Sequence[tuple[str, str]]) -> list[tuple[set[str], set[str]]]:
    """Fields and tags that belong together, of pairs of them: an area's fields share no tag with another's."""
    found: list[tuple[set[str], set[str]]] = []
    for field_path, tag in sorted(pairs):
        mine = [a for a in found if field_path in a[0] or tag in a[1]]
        found = [a for a in found if a not in mine] + [({field_path}.union(*[a[0] for a in mine]), {tag}.union(*[a[1] for a in mine]))]
    return found


def _by_area(held: DataFrame, areas: Sequence[tuple[set[str], set[str]]], side: str, together: int) -> tuple[DataFrame, DataFrame]:
    """Each kind with a number per area for what it holds there (``q0``, ``q1`` and so on for the side q; null where it
    holds nothing); and the profiles of these numbers (``q_sub``, ``tag``, ``profile``)."""
    area = F.coalesce(*[F.when(F.col("tag").isin(*tags), F.lit(k)) for k, (_, tags) in enumerate(areas)])
    sets = durable(held.withColumn("area", area).groupBy("kind", "n", "area").agg(F.array_sort(F.collect_list("profile")).alias("profiles")))
    subs = durable(sets.select("area", "profiles").distinct().withColumn("sub", F.monotonically_increasing_id()))
    columns = [F.max(F.when(F.col("area") == k, F.col("sub"))).alias(f"{side}{k}") for k in range(len(areas))]
    wide = sets.join(subs, ["area", "profiles"]).groupBy("kind", "n").agg(*columns).withColumn(f"{side}_salts", _salts(together)).drop("n").withColumnRenamed("kind", f"{side}_kind")
    members = subs.select("area", F.col("sub").alias(f"{side}_sub"), F.explode("profiles").alias("profile")).join(held.select("tag", "profile").distinct(), "profile")
    return durable(wide), durable(members)


def scored_by_profile(query_tokens: DataFrame, index: DataFrame, config: Config, together: int = TOGETHER) -> DataFrame | None:
    """As ``scored`` over all candidates, but of the least scores, and with their ``rank``; each two kinds of records are
    scored once, and each two profiles compared once. None if it wouldn't pay.

    Fields that together stay below the least score qualify no pair, so a pair needs something from another field: all
    profiles of those fields' tags are compared, and only kinds that are alike there meet. It pays if these comparisons
    are fewer than the pairs that share a block. A score is the sum over areas, whose contributions are looked up by what
    the two kinds hold there. Queries of a kind have one list of candidates, ranked once for each ``together`` of them;
    a query then steps over its own record.
    """
    q_rows, q_held, q_made = _profiled(query_tokens, together)
    c_rows, c_held, c_made = (q_rows, q_held, q_made) if query_tokens is index else _profiled(index, together)
    weights = q_made.where(~F.col("token_type").isin(*BLOCKING)).groupBy("field_path").agg(F.max("weight").alias("w"), F.collect_set("tag").alias("tags")).orderBy("w", "field_path").collect()
    total, tags, needed = 0.0, set(), []
    for r in weights:
        total += r.w
        if total > config.min_score - 1e-9:
            needed.append(r.field_path)
            tags |= set(r.tags)
    if not needed:
        return None
    key = ["tag", "token_type", "token_value"]
    sizes = lambda made, held, name: made.where(F.col("token_type").isin(*BLOCKING)).select(F.col("id").alias("profile"), *key).distinct().join(held.groupBy("profile").agg(F.sum("n").alias("n")), "profile").groupBy(*key).agg(F.sum("n").cast("double").alias(name))
    shared = sizes(q_made, q_held, "x").join(sizes(c_made, c_held, "y"), key).agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0.0
    several = lambda held: held.where(F.col("tag").isin(*tags)).groupBy("tag").agg(F.countDistinct("profile").cast("double").alias("n"))
    compared = several(q_held).join(several(c_held).withColumnRenamed("n", "m"), "tag").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0.0
    if compared >= shared:
        return None
    # a fixed number of tasks, since adaptive execution would put these few bytes into one
    spread = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.concat_ws("|", "salt", "field_path", "tag")
    asking = _asking(q_made).where(F.col("tag").isin(*tags)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).withColumn("slot", slot).drop("salt")
    answering = _answering(c_made).where(F.col("tag").isin(*tags)).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(spread))).withColumn("slot", slot).drop("salt", "field_path", "tag")
    wide = asking.repartition(spread, "slot").join(answering.repartition(spread, "slot"), "slot")
    alike = durable(_best(wide.where("q.token_type = c.token_type"), config))

    areas = _areas([(r.field_path, r.tag) for r in q_made.select("field_path", "tag").union(c_made.select("field_path", "tag")).distinct().collect()])
    starts = [k for k, (fields, _) in enumerate(areas) if fields & set(needed)]
    q_wide, q_members = _by_area(q_held, areas, "q", together)
    c_wide, c_members = _by_area(c_held, areas, "c", together)
    q_side, c_side = q_members.withColumnRenamed("profile", "query"), c_members.withColumnRenamed("profile", "id")

    def meeting(k: int, subs: DataFrame) -> DataFrame:
        """Kinds that hold the pairs ``subs`` (``q0``, ``c0`` for area 0) there; what many kinds hold is dealt to blocks."""
        blocks = c_wide.groupBy(f"c{k}").agg(F.count(F.lit(1)).alias("n")).select(f"c{k}", _salts(together).alias("blocks"))
        left = subs.join(blocks, f"c{k}").join(q_wide, f"q{k}").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = c_wide.join(blocks, f"c{k}").withColumn("block", F.pmod(F.xxhash64("c_kind"), F.col("blocks")).cast("int")).drop("blocks")
        return left.repartition(spread, f"c{k}", "block").join(right.repartition(spread, f"c{k}", "block"), [f"c{k}", "block"]).drop("block")

    near = alike.where(F.col("field_path").isin(*needed)).select("query", "id").distinct()
    near = durable(near.join(q_side.select("area", "q_sub", "query"), "query").join(c_side.select("c_sub", "id"), "id").select("area", "q_sub", "c_sub").distinct())
    also = [meeting(k, near.where(F.col("area") == k).select(F.col("q_sub").alias(f"q{k}"), F.col("c_sub").alias(f"c{k}"))).select(F.lit(j).alias("area"), F.col(f"q{j}").alias("q_sub"), F.col(f"c{j}").alias("c_sub")).where("q_sub is not null and c_sub is not null").distinct() for k in starts for j in range(len(areas)) if j != k]
    met = durable(reduce(DataFrame.unionByName, [near, *also]).distinct().join(q_side.drop("area"), "q_sub").join(c_side.drop("area"), ["c_sub", "tag"]))
    once = durable(met.select("tag", "query", "id").distinct())
    others = once.where(~F.col("tag").isin(*tags)).drop("tag").join(_asking(q_made), "query").join(_answering(c_made), ["id", "field_path", "tag"])
    parts = alike.unionByName(_best(others.where("q.token_type = c.token_type"), config)).groupBy("query", "id").agg(F.collect_list(F.struct("field_path", "b")).alias("parts"))
    token = lambda made, name: made.where(F.col("token_type").isin(*BLOCKING)).select(F.col("id").alias(name), *key)
    blocked = once.join(token(q_made, "query"), ["query", "tag"]).join(token(c_made, "id"), ["id", *key]).select("query", "id").distinct().withColumn("blocked", F.lit(True))
    facts = durable(once.drop("tag").join(parts, ["query", "id"], "left").join(blocked, ["query", "id"], "left").where("parts is not null or blocked"))
    fields = met.join(facts, ["query", "id"]).select("area", "q_sub", "c_sub", "blocked", F.explode_outer("parts").alias("p")).groupBy("area", "q_sub", "c_sub", "p.field_path").agg(F.max("p.b").alias("b"), F.max("blocked").alias("blocked"))
    sums = durable(fields.groupBy("area", "q_sub", "c_sub").agg(F.sum("b.part").alias("sum"), F.collect_list("b.text").alias("texts"), F.max("blocked").alias("blocked"), F.max(F.col("field_path").isin(*needed)).alias("near")))
    of = lambda k: sums.where(F.col("area") == k).select(F.col("q_sub").alias(f"q{k}"), F.col("c_sub").alias(f"c{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("sum", "texts", "blocked", "near")])
    asked = q_held.select(F.col("kind").alias("q_kind"), "tag", "profile").join(q_made.withColumnRenamed("id", "profile"), ["tag", "profile"])
    possible = best_possible(asked.select(F.col("q_kind").alias("id"), "field_path", "token_type", "weight")).withColumnRenamed("query", "q_kind").where("possible > 0")
    q_wide = durable(q_wide.join(possible, "q_kind"))

    def summed(pairs: DataFrame) -> DataFrame:
        """Pairs of kinds that reach the least scores."""
        for k in range(len(areas)):
            if f"sum{k}" not in pairs.columns:
                pairs = pairs.join(of(k), [f"q{k}", f"c{k}"], "left")
        every = range(len(areas))
        pairs = pairs.withColumn("score", reduce(Column.__add__, [F.coalesce(f"sum{k}", F.lit(0.0)) for k in every])).withColumn("normalized", F.col("score") / F.col("possible"))
        pairs = pairs.where(F.coalesce(*[F.col(f"blocked{k}") for k in every]) & (F.col("score") >= config.min_score) & (F.col("normalized") >= config.min_normalized))
        return pairs.withColumn("matched_on", F.array_sort(F.concat(*[F.coalesce(f"texts{k}", F.array().cast("array<string>")) for k in every])))

    found = []
    for k in starts:  # pairs near in an earlier area have been met there
        fresh = reduce(Column.__and__, [~F.coalesce(f"near{j}", F.lit(False)) for j in starts if j < k], F.lit(True))
        found.append(summed(meeting(k, of(k).where(f"near{k}"))).where(fresh).select("q_kind", "q_salts", "c_kind", "c_salts", "score", "normalized", "matched_on"))
    salted = reduce(DataFrame.unionByName, found)
    for side in "qc":
        salted = salted.withColumn(f"{side}_salt", F.explode(F.sequence(F.lit(0), F.col(f"{side}_salts") - 1))).drop(f"{side}_salts")
    queries = q_rows.select(F.col("id").alias("query"), F.col("kind").alias("q_kind"), F.col("salt").alias("q_salt"))
    held = c_rows.select("id", F.col("kind").alias("c_kind"), F.col("salt").alias("c_salt"))
    place = F.row_number().over(Window.partitionBy("q_kind", "q_salt").orderBy(F.col("normalized").desc(), F.col("score").desc(), "id"))
    listed = salted.join(held, ["c_kind", "c_salt"]).drop("c_kind", "c_salt").withColumn("place", place)
    self = queries.join(held.select(F.col("id").alias("query"), "c_kind"), "query", "left")
    own = summed(self.select("q_kind", "c_kind").distinct().join(q_wide, "q_kind").join(c_wide, "c_kind")).select("q_kind", "c_kind", F.struct(-F.col("normalized"), -F.col("score")).alias("own"))
    before = F.struct("own", "query") < F.struct(F.struct(-F.col("normalized"), -F.col("score")), "id")
    each = listed.join(self.join(own, ["q_kind", "c_kind"], "left").drop("c_kind"), ["q_kind", "q_salt"]).where("query <> id")
    return each.select("query", "id", "score", "normalized", "matched_on", (F.col("place") - F.when(F.col("own").isNotNull() & before, 1).otherwise(0)).alias("rank"))


def find(query_tokens: DataFrame, index: DataFrame, config: Config = Config(), deleted: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Candidates that reach both least scores, best first within a query (``rank``), with ``status`` ACTIVE or
    DELETED (``deleted``: ids). No rows for a query without tokens or when linkage is off. ``limit`` cuts the ranked
    result only; ``config.limit`` cuts before scoring as well."""
    if not config.enabled:
        return scored(candidates(query_tokens.limit(0), index), query_tokens, index, config).withColumn("status", F.lit("ACTIVE")).withColumn("rank", F.lit(0))
    found = scored_by_profile(query_tokens, index, config) if config.limit is None else None
    if found is None:
        found = scored(candidates(query_tokens, index, config.limit), query_tokens, index, config)
    found = found.where((F.col("score") >= config.min_score) & (F.col("normalized") >= config.min_normalized))
    gone = (deleted.select("id").distinct() if deleted is not None else found.select("id").limit(0)).withColumn("_gone", F.lit(True))
    if "rank" not in found.columns:
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("normalized").desc(), F.col("score").desc(), "id")))
    ranked = found.join(gone, "id", "left").withColumn("status", F.when(F.col("_gone"), "DELETED").otherwise("ACTIVE")).drop("_gone")
    most = limit or config.limit
    return (ranked if most is None else ranked.where(F.col("rank") <= most)).select("query", "id", "score", "normalized", "matched_on", "status", "rank")


def auto_link(requests: DataFrame, found: DataFrame, config: Config) -> DataFrame:
    """What creating each request (``query``) does: ``created`` without candidates or auto-linking, ``returned`` (with
    ``id``) if the best candidate is active and the setting returns it, else ``conflict``."""
    best = found.where("rank = 1").select("query", "id", "status")
    joined = requests.select("query").join(best, "query", "left")
    if not config.auto_link:
        return joined.select("query", F.lit("created").alias("action"), F.lit(None).cast("bigint").alias("id"))
    returns = (F.col("status") == "ACTIVE") & F.lit(config.on_match == "returnExisting")
    action = F.when(F.col("id").isNull(), "created").when(returns, "returned").otherwise("conflict")
    return joined.select("query", action.alias("action"), F.when(returns, F.col("id")).alias("id"))


def tokens_of(index: DataFrame, ids: DataFrame) -> DataFrame:
    """All tokens of candidate ids."""
    return index.join(ids.select("id").distinct(), "id", "left_semi")
