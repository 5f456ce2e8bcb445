"""Matching of records that share no key: sorted neighbourhood, weighted similarities, one-to-one assignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilframe.llm.assignment import choose
from veilframe.llm.persons import ATTRIBUTES
from veilframe.llm.sliding import EDGE, OUT_DDL, PAIR, PAIRED, RECORD, SIZE, slide
from veilframe.plans.durable import durable, release
from veilframe.plans.skew import HOT_ROWS, lookup

#: Neighbours compared on either side in each sorted order.
WINDOW = 6
#: Records of one sorted stretch that a task holds; stretches overlap by the window.
STRETCH = 4_096
#: Least total of the weights below for a match, and the total that counts as certain.
LEAST, CERTAIN = 9.0, 20.0

#: Weights of evidence: agreement in full, nearly, in part; conflict.
WEIGHTS = {
    "first": {"same": 4.0, "near": 3.0, "short": 2.5, "initial": 1.0, "other": -10.0},
    "last": {"same": 4.0, "near": 3.0, "part": 3.0, "other": -2.0},
    "birth": {"same": 6.0, "step": 2.5, "one": 1.0, "two": -2.0, "other": -6.0},
    "phone": {"same": 4.0, "other": -0.5},
    "email": {"same": 6.0, "other": -1.0},
    "street": {"same": 1.5, "other": 0.0},
    "zip": {"same": 1.5, "other": -0.5},
    "sex": {"same": 0.0, "other": -3.0},
}
#: Short forms of first names that are no beginning of the name.
SHORT_FORMS = {
    "kati": ["katrin", "katharina"], "lutz": ["ludwig"], "mia": ["maria"], "hanna": ["johanna"], "hannes": ["johannes"], "hans": ["johannes"], "andi": ["andreas"],
    "gitti": ["margit", "brigitte"], "resi": ["theresa", "therese"], "steff": ["stefan", "stefanie"], "steffi": ["stefanie"], "uli": ["ulrich", "ulrike"], "tina": ["christina", "martina"],
    "toni": ["anton", "antonia"], "sepp": ["josef"], "fritz": ["friedrich"], "gabi": ["gabriele"], "susi": ["susanne"], "moni": ["monika"], "lena": ["helena", "magdalena"],
    "lisa": ["elisabeth"], "betty": ["elisabeth"], "rudi": ["rudolf"], "willi": ["wilhelm"], "max": ["maximilian"], "klaus": ["nikolaus"], "basti": ["sebastian"], "nina": ["janina"], "britta": ["brigitte"],
}


def collapse(rows: DataFrame) -> DataFrame:
    """One row per record with the latest known value of every attribute: ``record``, ``project_id``, ``n`` rows, ``id``
    (the smallest) and the attributes. Aggregated partially, whatever a record's number of copies."""
    latest = [F.max(F.when(F.col(a).isNotNull(), F.struct("updated", "id", F.col(a).alias("v"))))["v"].alias(a) for a in ATTRIBUTES]
    return rows.groupBy("record").agg(F.first("project_id").alias("project_id"), F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), *latest)


def passes() -> dict[str, Column]:
    """The composite sort keys. Names go in alphabetical order, so that exchanged ones meet; a key is null, and the
    record absent from that order, if its leading attribute isn't known."""
    names = F.array_join(F.sort_array(F.array_compact(F.array("first", "last"))), " ")
    names = F.when(names != "", names)
    return {
        "birth": F.concat_ws("|", F.col("birth"), F.coalesce(names, F.lit("")), "zip"),
        "names": F.concat_ws("|", names, F.coalesce("birth", F.lit("")), "zip"),
        "phone": F.concat_ws("|", F.col("phone"), F.coalesce("first", F.lit("")), "birth"),
        "email": F.concat_ws("|", F.col("email"), F.coalesce("first", F.lit(""))),
        "home": F.concat_ws("|", F.col("zip"), F.coalesce("first", F.lit("")), "last", "birth"),
    }


#: The attribute that must be known for a record to take part in an order.
LEADING = {"birth": ["birth"], "names": ["first", "last"], "phone": ["phone"], "email": ["email"], "home": ["zip", "first"]}


def neighbours(records: DataFrame, least: float, window: int = WINDOW, stretch: int = STRETCH) -> DataFrame:
    """Pairs of records of different projects within ``window`` places of each other in one of the sorted orders, as
    far as they can reach ``least``: ``record``, ``project_id``, ``first``, ``last``, ``birth``, the same of the other
    and ``apart``, the weight of all but the names.

    All orders are sorted at once over range partitions, and a window slides over each partition; names add at most
    two weights, so a pair that falls short by more is dropped there. Pairs that span partitions come from the
    partitions' first and last ``window`` records: these get their places in the whole order (sizes of partitions,
    one row each, are summed), are cut into stretches of ``stretch`` places that repeat the last records of the
    stretch before, and slide again. So every window is complete, and however many records share a key, no task holds
    more than its range.
    """
    reach = least - WEIGHTS["first"]["same"] - WEIGHTS["last"]["same"]
    known = lambda names: reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in names])
    keys = F.array_compact(F.array(*[F.when(known(LEADING[name]), F.struct(F.lit(number).alias("pass"), key.alias("key"))) for number, (name, key) in enumerate(passes().items())]))
    code = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.xxhash64(c)), F.lit(0)).cast("bigint").alias(c)
    compact = records.select("record", "project_id", "first", "last", F.coalesce(F.col("birth").cast("int"), F.lit(0)).alias("birth"), *[code(c) for c in ("phone", "email", "street", "zip", "sex")], keys.alias("keys"))
    expanded = compact.withColumn("k", F.explode("keys")).select("*", "k.pass", "k.key").drop("k", "keys")
    spread = max(1, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = expanded.repartitionByRange(spread, "pass", "key", "record").sortWithinPartitions("pass", "key", "record")
    columns = [n for n, _ in RECORD]
    placed = ordered.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).withColumn("stretch", F.lit(0).cast("bigint")).withColumn("own", F.lit(0).cast("bigint"))
    within = durable(placed.select(*columns).mapInArrow(slide(window, reach, WEIGHTS, across=False), OUT_DDL))

    sizes = within.where(F.col("kind") == SIZE).select("part", F.col("place").alias("held"))
    offsets = sizes.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    edges = within.where(F.col("kind") == EDGE).select(*columns).join(F.broadcast(offsets), "part").withColumn("place", F.col("place") + F.col("offset"))
    own = F.floor(F.col("place") / stretch).cast("bigint")
    lent = F.when(F.col("place") % stretch >= stretch - window, F.array(own, own + 1)).otherwise(F.array(own))
    edges = edges.withColumn("own", own).withColumn("stretch", F.explode(lent)).select(*columns).repartition("stretch").sortWithinPartitions("stretch", "place")
    between = edges.mapInArrow(slide(window, reach, WEIGHTS, across=True), OUT_DDL)
    pair = ["record", "project_id", "first", "last", "birth", *[n for n, _ in PAIR]]
    return within.where(F.col("kind") == PAIRED).select(*pair).unionByName(between.select(*pair))


def _near(a: Column, b: Column) -> Column:
    """At most two edits, one in short texts."""
    size = F.greatest(F.length(a), F.length(b))
    return F.levenshtein(a, b, 2).between(0, 2) & (size > 3) & ((size > 5) | (F.levenshtein(a, b, 1) >= 0))


def _short(a: Column, b: Column) -> Column:
    forms = F.create_map(*[F.lit(x) for k, v in SHORT_FORMS.items() for x in (k, v and F.array(*map(F.lit, v)))])
    listed = F.coalesce(F.array_contains(F.element_at(forms, a), b) | F.lit(False), F.lit(False))
    return listed | ((F.length(a) >= 3) & F.startswith(b, a))


def _first(a: Column, b: Column) -> Column:
    w = WEIGHTS["first"]
    shared = F.arrays_overlap(F.split(a, " "), F.split(b, " "))
    initial = ((F.length(a) == 1) & F.startswith(b, a)) | ((F.length(b) == 1) & F.startswith(a, b))
    return F.when(a == b, w["same"]).when(_near(a, b), w["near"]).when(shared | _short(a, b) | _short(b, a), w["short"]).when(initial, w["initial"]).otherwise(w["other"])


def _last(a: Column, b: Column) -> Column:
    w = WEIGHTS["last"]
    return F.when(a == b, w["same"]).when(_near(a, b), w["near"]).when(F.arrays_overlap(F.split(a, " "), F.split(b, " ")), w["part"]).otherwise(w["other"])


def name_weight() -> Column:
    """Weight of first and last name of a pair, compared straight and exchanged; the better way counts.

    A first name that differs altogether is forgiven only with other strong evidence (an equal e-mail address), so that
    twins and households stay apart; a differing last name counts more if a birth date isn't known.
    """
    fa, la, fb, lb = F.col("first"), F.col("last"), F.col("other_first"), F.col("other_last")
    last = F.coalesce(_last(la, lb), F.lit(0.0))
    unsure = F.when((last < 0) & ((F.col("birth") == 0) | (F.col("other_birth") == 0)), -1.5).otherwise(0.0)
    straight = F.coalesce(_first(fa, fb), F.lit(0.0)) + last + unsure
    crossed = F.when((fa != fb) & (la != lb), _first(fa, lb) + _first(la, fb) - 0.5)
    return F.greatest(straight, crossed)


def links(records: DataFrame, least: float = LEAST, window: int = WINDOW, stretch: int = STRETCH) -> DataFrame:
    """Pairs of records of different projects that pass: ``x``, ``y`` (records, the smaller project first), their
    projects ``px``, ``py`` and ``weight``, the evidence in thousandths."""
    pairs = neighbours(records, least, window, stretch).withColumn("weight", F.col("apart") + name_weight()).where(F.col("weight") >= least)
    forward = F.col("project_id") < F.col("other_project")
    one, two = F.struct(F.col("record").alias("r"), F.col("project_id").alias("p")), F.struct(F.col("other").alias("r"), F.col("other_project").alias("p"))
    sided = pairs.select(F.when(forward, one).otherwise(two).alias("x"), F.when(forward, two).otherwise(one).alias("y"), F.round(F.col("weight") * 1000).cast("long").alias("weight"))
    return sided.groupBy(F.col("x.r").alias("x"), F.col("y.r").alias("y"), F.col("x.p").alias("px"), F.col("y.p").alias("py")).agg(F.max("weight").alias("weight"))


def assign(found: DataFrame) -> DataFrame:
    """A one-to-one assignment within each pair of projects that maximises the total weight, exactly.

    Links whose two records have no other link in that pair of projects are settled at once. The contested rest, few
    links by nature, falls into components of connected links, which are found by spreading labels until none changes;
    each is solved by shortest augmenting paths (``assignment.best``).
    """
    left, right = ["x", "py"], ["y", "px"]
    degree = found.withColumn("dx", F.count(F.lit(1)).over(Window.partitionBy(*left))).withColumn("dy", F.count(F.lit(1)).over(Window.partitionBy(*right)))
    graph = durable(degree)
    settled = graph.where("dx = 1 and dy = 1").drop("dx", "dy")
    open_links = graph.where("dx > 1 or dy > 1").drop("dx", "dy")
    if open_links.isEmpty():
        return settled
    return settled.unionByName(durable(choose(open_links, left, right)))


def closed(matched: DataFrame) -> DataFrame:
    """The matches together with those implied by way of one or two other projects.

    After the assignment a record has at most one partner per project, so a chain has as many ways on as there are
    projects. An implied pair has the weight of its weaker link, and is left out if either record has a partner of
    its own in the other's project.
    """
    both = matched.select("x", "px", "y", "py", "weight").unionByName(matched.select(F.col("y").alias("x"), F.col("py").alias("px"), F.col("x").alias("y"), F.col("px").alias("py"), "weight"))
    for _ in range(2):
        onward = both.select(F.col("x").alias("y"), F.col("px").alias("py"), F.col("y").alias("z"), F.col("py").alias("pz"), F.col("weight").alias("w2"))
        implied = both.join(onward, ["y", "py"]).where("px <> pz").groupBy("x", "px", F.col("z").alias("y"), F.col("pz").alias("py")).agg(F.max(F.least("weight", "w2")).alias("weight"))
        best = implied.groupBy("x", "py").agg(F.max(F.struct("weight", "y")).alias("b"))
        implied = implied.join(best, ["x", "py"]).where("y = b.y").drop("b")
        fresh = implied.join(both.select("x", "py"), ["x", "py"], "left_anti").join(both.select(F.col("y"), F.col("px")), ["y", "px"], "left_anti")
        mutual = fresh.join(fresh.select(F.col("y").alias("x"), F.col("x").alias("y")), ["x", "y"], "left_semi")
        before, both = both, durable(both.unionByName(mutual.select(*both.columns)))
        release(before)
    return both.where("px < py")


def match(rows: DataFrame, least: float = LEAST, window: int = WINDOW, stretch: int = STRETCH) -> DataFrame:
    """Matched records with ``confidence`` (0 to 1): ``x``, ``y``, ``confidence``, from ``persons.person_rows``."""
    records = durable(collapse(rows))
    pairs = closed(assign(links(records, least, window, stretch)))
    return pairs.select("x", "y", F.least(F.lit(1.0), F.col("weight") / (1000.0 * CERTAIN)).alias("confidence"))


def expand(pairs: DataFrame, rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All pairs of rows of matched records: ``id_a`` < ``id_b``, ``confidence``.

    A record has one partner per project at most but may have very many rows. Records are counted; at either meeting
    the rows of a hot record are salted, and whatever meets them is repeated once per salt. At the second one the rows
    that ``x`` brought are salted as well, where they are many, so neither side gathers in one task.
    """
    sizes = durable(rows.groupBy("record").agg(F.count(F.lit(1)).alias("n")))
    of = lambda key: sizes.select(F.col("record").alias(key), F.col("n").alias(f"n_{key}"))
    side = lambda key, name: rows.select(F.col("record").alias(key), F.col("id").alias(name))
    sized = durable(pairs.select("x", "y", "confidence").join(of("x"), "x").join(of("y"), "y"))
    first = lookup(side("x", "a"), sized, ["x"], n="n_x", spread="a", hot_rows=hot_rows, counts=of("x"))
    part = F.ceil(F.col("n_x") / F.lit(hot_rows)).cast("int")
    split = first.select("y", "n_y", "a", "confidence", "x", F.pmod(F.xxhash64("a"), part).cast("int").alias("part"))
    # (y, x, part): the rows of y once for each part of its partner's rows
    wanted = sized.select("y", "x", "n_y", F.explode(F.sequence(F.lit(0), part - 1)).alias("part"))
    others = lookup(side("y", "b"), wanted, ["y"], n="n_y", spread="b", hot_rows=hot_rows, counts=of("y"))
    share = F.ceil(F.col("n_y") / F.lit(hot_rows)).cast("int")
    right = others.select("y", "x", "part", "b", F.pmod(F.xxhash64("b"), share).cast("int").alias("share"))
    left = split.select("y", "x", "part", "a", "confidence", F.explode(F.sequence(F.lit(0), share - 1)).alias("share"))
    both = left.join(right, ["y", "x", "part", "share"])
    return both.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "confidence")


def membership(pairs: DataFrame, rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of a matched record: ``id``, ``person`` (the smallest id of the rows of the record and those it is
    matched with), ``links`` (how many rows of other projects it is paired with) and ``confidence`` of its weakest
    match. The pairs themselves are never made."""
    sizes = durable(rows.groupBy("record").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")))
    both = pairs.select("x", "y", "confidence").unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "confidence"))
    others = both.join(sizes.select(F.col("record").alias("y"), F.col("n").alias("others"), F.col("least").alias("other")), "y")
    linked = others.groupBy(F.col("x").alias("record")).agg(F.sum("others").alias("links"), F.min("other").alias("other"), F.min("confidence").alias("confidence")).join(sizes, "record")
    found = lookup(rows.select("record", "id"), linked, ["record"], hot_rows=hot_rows)
    return found.select("id", F.least("least", "other").alias("person"), "links", "confidence")
