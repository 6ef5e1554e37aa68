"""Entity resolution: the batch job (star clusters) and the engine (weighted scores, components, survivorship)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize, scratch
from .components import connected_components
from .similarity import edit_join

# Weights of the compared attributes.
WEIGHTS = {"name": 0.35, "date_of_birth": 0.20, "address": 0.15, "national_id": 0.15, "passport": 0.10, "tax_id": 0.05, "company_reg": 0.05}


def alike_names(entities: DataFrame, threshold: float = 0.8, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """``(id, n)`` of the entities that have a name, and ``(n, n_b, similarity)`` of names alike in one Soundex and first-letter block, both ways round."""
    e = entities.select("id", T.normalized_name(F.col(name)).alias("n")).where("n is not null")
    names = e.select("n").distinct().withColumns({"sdx": F.soundex("n"), "fc": F.substring("n", 1, 1)})
    pairs = edit_join(names, threshold, ["sdx", "fc"]).withColumnsRenamed({"a": "n", "b": "n_b"})
    return e, pairs.unionByName(pairs.select(F.col("n_b").alias("n"), F.col("n").alias("n_b"), "similarity"))


def job_pairs(entities: DataFrame, threshold: float = 0.8, name: str = "name") -> DataFrame:
    """``(id_a, id_b, similarity)`` of entities in one Soundex and first-letter block whose names are alike.

    Only distinct names are compared, by pieces that they share; entities meet by the names that are alike.
    """
    e, alike = alike_names(entities, threshold, name)
    both = alike.unionByName(e.select("n", F.col("n").alias("n_b"), F.lit(1.0).alias("similarity")).distinct())
    right = e.select(F.col("id").alias("id_b"), F.col("n").alias("n_b"))
    return e.join(both, "n").join(right, "n_b").where("id < id_b").select(F.col("id").alias("id_a"), "id_b", "similarity")


def job_links(entities: DataFrame, threshold: float = 0.8, name: str = "name") -> DataFrame:
    """``(id, class_id, links, avg_similarity)``: the least id of the same name, and how many other entities are alike.

    Works on names with their numbers of entities; pairs of ids are not written out. Entities without a name have no links.
    """
    e, alike = alike_names(entities, threshold, name)
    sizes = e.groupBy("n").agg(F.min("id").alias("class_id"), F.count("*").alias("size"))
    others = alike.join(sizes.select(F.col("n").alias("n_b"), F.col("size").alias("m")), "n_b").groupBy("n").agg(F.sum("m").alias("m"), F.sum(F.col("similarity") * F.col("m")).alias("s"))
    m, same = F.coalesce("m", F.lit(0)), F.col("size") - 1
    facts = sizes.join(others, "n", "left").select("n", "class_id", (m + same).alias("links"), F.try_divide(F.coalesce("s", F.lit(0.0)) + same, (m + same).cast("double")).alias("avg_similarity"))
    named = entities.select("id", T.normalized_name(F.col(name)).alias("n")).join(facts, "n", "left")
    return named.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "avg_similarity")


def job_clusters(pairs: DataFrame) -> DataFrame:
    """Stars: each left entity with its matches; not transitive."""
    return pairs.groupBy(F.col("id_a").alias("id")).agg(F.array_sort(F.collect_list("id_b")).alias("matches"), F.avg("similarity").alias("avg_similarity"), F.count("*").alias("match_count"))


def job_stars(entities: DataFrame, threshold: float = 0.8, name: str = "name") -> DataFrame:
    """``job_clusters`` of ``job_pairs`` with the other columns of ``entities``; no pairs of ids and no lists of matches go between tasks.

    The ids of names alike are put together and sorted once a name, and each entity, which brings its columns along, takes the later ones.
    """
    e, alike = alike_names(entities, threshold, name)
    both = alike.unionByName(e.select("n", F.col("n").alias("n_b"), F.lit(1.0).alias("similarity")).distinct())
    ids = e.where("id is not null").groupBy(F.col("n").alias("n_b")).agg(F.collect_list("id").alias("ids"))
    lists = both.join(ids, "n_b").groupBy(F.col("n").alias("__n")).agg(F.collect_list(F.struct("similarity", "ids")).alias("lists"))
    with_similarity = F.transform("lists", lambda g: F.transform(g["ids"], lambda i: F.struct(i.alias("id"), g["similarity"].alias("s"))))
    near = lists.select("__n", F.sort_array(F.flatten(with_similarity), asc=False).alias("near"))
    near = near.select("__n", F.transform("near", lambda x: x["id"]).alias("__ids"), F.transform("near", lambda x: x["s"]).alias("__s"))
    rows = entities.withColumn("__n", T.normalized_name(F.col(name))).where("id is not null and __n is not null")
    later = F.array_position("__ids", F.col("id")).cast("int") - 1  # the greatest ids come first
    stars = rows.join(near, "__n").withColumn("__later", later).where("__later > 0")
    total = F.aggregate(F.slice("__s", F.lit(1), F.col("__later")), F.lit(0.0), lambda t, s: t + s)
    matches = F.reverse(F.slice("__ids", F.lit(1), F.col("__later")))
    return stars.select("id", matches.alias("matches"), (total / F.col("__later")).alias("avg_similarity"), F.col("__later").cast("long").alias("match_count"), *[c for c in entities.columns if c != "id"])


def resolve_job(entities: DataFrame, threshold: float = 0.8) -> DataFrame:
    return job_stars(entities, threshold)


def job_stats(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.count("*").alias("clusters"), F.sum("match_count").alias("matches"), F.avg("avg_similarity").alias("avg_similarity"))


STRATEGIES = {
    "soundex": lambda n, y: F.array(F.concat(F.lit("soundex_"), T.coded_soundex(n))),
    "metaphone": lambda n, y: F.array(F.concat(F.lit("metaphone_"), T.metaphone(n))),
    "ngram": lambda n, y: F.transform(T.blocking_ngrams(n, 3, 3), lambda g: F.concat(F.lit("ngram_"), g)),
    "first_letter": lambda n, y: F.array(F.concat(F.lit("fl_"), F.coalesce(F.nullif(F.upper(F.substring(n, 1, 1)), F.lit("")), F.lit("X")), F.lit("_"), F.coalesce(y, F.lit("0000")))),
}


def location_key(country: Column, city: Column) -> Column:
    part = lambda c, n: F.coalesce(F.nullif(F.upper(F.substring(c, 1, n)), F.lit("")), F.lit("XX"))
    return F.concat_ws("_", part(country, 2), part(city, 3))


def standardize(records: DataFrame) -> DataFrame:
    """Records ``(id, source_system, entity_type, attributes map)`` with clean name, address and date of birth."""
    a = F.col("attributes")
    clean = lambda k, v: F.when(k == "name", T.standard_name(v)).when(k == "address", T.standard_address(v)).otherwise(v)
    return records.withColumn("attributes", F.transform_values(a, clean))


def block_lists(records: DataFrame, strategies: Sequence[str] = ("soundex", "ngram")) -> DataFrame:
    """The records that have a name, with their ``blocks``."""
    name, year = F.element_at("attributes", "name"), F.substring(F.element_at("attributes", "date_of_birth"), 1, 4)
    # a name that is not a strategy is an attribute whose equal values make a block
    keys = F.array_distinct(F.array_compact(F.concat(*[STRATEGIES[s](name, year) if s in STRATEGIES else F.array(F.concat(F.lit(f"{s}_"), F.nullif(F.element_at("attributes", s), F.lit("")))) for s in strategies])))
    return records.where(F.coalesce(name, F.lit("")) != "").withColumn("blocks", keys)


def blocking_keys(records: DataFrame, strategies: Sequence[str] = ("soundex", "ngram")) -> DataFrame:
    return block_lists(records, strategies).select("id", F.explode("blocks").alias("block"))


def pair_score(a: Column, b: Column, names: Callable[[Column, Column], Column] = T.name_score, at: Callable[[Column, str], Column] = F.element_at) -> Column:
    """Weighted mean over attributes that both have; names by the composite score, addresses by bigrams, the rest by equality."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for k, w in WEIGHTS.items():
        x, y = at(a, k), at(b, k)
        both = (F.coalesce(x, F.lit("")) != "") & (F.coalesce(y, F.lit("")) != "")
        s = names(x, y) if k == "name" else T.gram_similarity(x, y, 2) if k == "address" else F.when(x == y, 1.0).otherwise(0.0)
        total, weight = total + F.when(both, s * w).otherwise(0.0), weight + F.when(both, w).otherwise(0.0)
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


#: So many groups of a key are compared with the rest of it in one task, and so many pairs make a task.
BLOCK_PART = 500
TASK_PAIRS = 5_000_000
#: Attributes that count as equal or not.
EXACT = tuple(k for k in WEIGHTS if k not in ("name", "address"))


def compatible(threshold: float, equal: int = 0) -> dict[int, list[int]]:
    """For each set of attributes that a record has (a bit each, EXACT and the address last), the sets that may go with it.

    Two records that have just the EXACT values of ``equal`` (bits too) in common reach the threshold only if what else both
    have weighs little enough beside those, a perfect name and, where both have one, address.
    """
    weights, address = [WEIGHTS[k] for k in EXACT], 1 << len(EXACT)

    def may(both: int) -> bool:
        best = WEIGHTS["name"] + (WEIGHTS["address"] if both & address else 0.0) + sum(w for i, w in enumerate(weights) if equal >> i & 1)
        unequal = sum(w for i, w in enumerate(weights) if (both & ~equal) >> i & 1)
        return both & equal == equal and best / (best + unequal) >= threshold - 1e-9

    every = range(2 * address)
    return {p: [q for q in every if may(p & q)] for p in every}


def name_needed(threshold: float, equal: int, both: int) -> float:
    """The least name score at which records that both have ``both``, and of it ``equal`` alike, may reach the threshold."""
    weights, address = [WEIGHTS[k] for k in EXACT], WEIGHTS["address"] if both >> len(EXACT) & 1 else 0.0
    of = lambda bits: sum(w for i, w in enumerate(weights) if bits >> i & 1)
    return (threshold * (WEIGHTS["name"] + address + of(both)) - of(equal) - address) / WEIGHTS["name"]


def sure_score(equal: Column, both: Column, name: Column, address: Column) -> Column:
    """``pair_score`` of records that both have ``both`` and of it at least ``equal`` alike, were the rest unequal."""
    total, weight = F.lit(0.0), F.lit(0.0)
    has = lambda bits, i: bits.bitwiseAND(1 << i) != 0
    for k, w in WEIGHTS.items():
        i = EXACT.index(k) if k in EXACT else len(EXACT)
        there = F.lit(True) if k == "name" else has(both, i)
        s = F.when(there, name * w if k == "name" else address * w) if k not in EXACT else F.when(has(equal, i), w)
        total, weight = total + s.otherwise(0.0), weight + F.when(there, w).otherwise(0.0)
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


def matching_pairs(records: DataFrame, strategies: Sequence[str] = ("soundex", "ngram"), threshold: float = 0.75) -> DataFrame:
    """``(id_a, id_b, score)`` that connect all records of a score of at least ``threshold`` that share a block; a score is what is sure of it.

    Records with equal scored attributes are one class, linked to its least id. Classes of one name, address and blocks are a
    unit. For each set of EXACT attributes (none, too), classes of one unit, one set of attributes that they have and equal
    values in that set are a group: of two groups that have the same values, all pairs of classes reach what they
    reach if the rest is unequal. So groups meet, not records, and where groups match, their least ids are linked and every
    member is linked to the least id of one group that matches its own. Each pair of names is scored once, if a bound
    without the Jaro score lets it. Each pair of groups meets once, in the first block that it shares; a large key is dealt over as many tasks
    as it has parts of BLOCK_PART groups. What is written meanwhile lies in the shared folder, which the result reads.
    """
    spark, at = records.sparkSession, F.col("attributes")
    facts = F.struct(*[F.coalesce(F.element_at(at, k), F.lit("")).alias(k) for k in WEIGHTS]).alias("facts")
    rows = records.select("id", facts, at)
    reps = block_lists(rows.groupBy("facts").agg(F.min_by("attributes", "id").alias("attributes"), F.min("id").alias("id")), strategies)
    fact = lambda k: F.col(f"facts.{k}")
    shape = sum((F.when(fact(k) != "", 1 << i).otherwise(0) for i, k in enumerate((*EXACT, "address"))), F.lit(0))
    # the classes are read several times, the records only to make them and to find their members
    classes = materialize(reps.select("id", F.array_sort("blocks").alias("blocks"), "facts", shape.alias("shape")), "classes")
    same = rows.join(classes.select("facts", F.col("id").alias("rep")), "facts").where("id <> rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("score"))

    shapes = sorted(r[0] for r in classes.select("shape").distinct().collect())  # at most 64
    fits = {}  # (equal, shape): the shapes up to it that go with it, and the name score that they need
    for equal in range(1 << len(EXACT)):
        sets = compatible(threshold, equal)
        fits |= {(equal, q): [(p, name_needed(threshold, equal, p & q)) for p in shapes if p in sets[q]] for q in shapes}
    masks = {q: [equal for (equal, of), ps in fits.items() if of == q and ps] for q in shapes}
    if not any(masks.values()):
        return same
    masks_of = F.create_map(*[x for q, ms in masks.items() for x in (F.lit(q), F.array(*map(F.lit, ms)).cast("array<int>"))])
    partner = lambda p, need: F.struct(F.lit(p).alias("shape"), F.lit(need).alias("need"))
    fits_of = F.create_map(*[x for (equal, q), ps in fits.items() if ps for x in (F.lit(equal * 64 + q), F.array(*[partner(p, need) for p, need in ps if p <= q]).cast("array<struct<shape:int,need:double>>"))])

    of_unit = classes.select("id", "shape", "facts", fact("name").alias("n"), fact("address").alias("address"), "blocks")
    units = materialize(of_unit.groupBy("n", "address", "blocks").agg(F.min("id").alias("unit")), "units")
    values = F.array(*[F.when(F.col("equal").bitwiseAND(1 << i) != 0, fact(k)).otherwise("") for i, k in enumerate(EXACT)])
    members = of_unit.join(units, ["n", "address", "blocks"]).select("id", "unit", "shape", "facts", F.explode(F.element_at(masks_of, F.col("shape"))).alias("equal")).select("id", "unit", "shape", "equal", values.alias("values"))
    members = materialize(members, "members")
    group = ["equal", "values", "unit", "shape"]
    groups = materialize(members.groupBy(*group).agg(F.min("id").alias("rep"), F.count("*").alias("size")), "groups")

    blocked = groups.join(units.select("unit", "blocks"), "unit").select("*", F.posexplode("blocks").alias("at", "block"))
    blocked = blocked.withColumn("before", F.slice("blocks", F.lit(1), F.col("at")))
    left = blocked.withColumn("key", F.struct("equal", "values", "block", "shape"))
    right = blocked.withColumn("fit", F.explode(F.element_at(fits_of, F.col("equal") * 64 + F.col("shape")))).withColumn("key", F.struct("equal", "values", "block", F.col("fit.shape").alias("shape")))
    sizes = left.groupBy("key").agg(F.count("*").alias("n")).join(right.groupBy("key").agg(F.count("*").alias("m"), F.max("shape").alias("top")), "key").where("n * m > 1 or top > key.shape")
    parts = materialize(sizes.select("key", F.expr(f"n div {BLOCK_PART} + 1").alias("parts"), (F.col("n") * F.col("m")).alias("pairs")), "keys")
    # adaptive execution goes by bytes, and these rows are few and their pairs many, so a number of tasks is named
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (parts.agg(F.sum("pairs")).first()[0] or 0) // TASK_PAIRS)
    side = lambda df, s, part, *cols: df.join(parts.drop("pairs"), "key").select("key", part.alias("part"), *[F.col(c).alias(f"{c.split('.')[-1]}_{s}") for c in ("unit", "shape", "rep", *cols)]).repartition(tasks, "key", "part")
    left = side(left, "a", F.pmod(F.xxhash64("unit"), F.col("parts")), "before")
    right = side(right, "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)), "blocks", "fit.need")
    once = ((F.col("shape_a") < F.col("shape_b")) | (F.col("unit_a") < F.col("unit_b"))) & ((F.size("before_a") == 0) | ~F.arrays_overlap("before_a", "blocks_b"))
    met = left.join(right, ["key", "part"]).where(once).select(F.col("key.equal").alias("equal"), "unit_a", "unit_b", "shape_a", "shape_b", "rep_a", "rep_b", F.col("need_b").alias("need"))
    own = groups.where("size > 1").select("equal", F.col("unit").alias("unit_a"), F.col("unit").alias("unit_b"), F.col("shape").alias("shape_a"), F.col("shape").alias("shape_b"), F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), F.explode(F.element_at(fits_of, F.col("equal") * 64 + F.col("shape"))).alias("fit"))
    met = met.unionByName(own.where("fit.shape = shape_a").withColumn("need", F.col("fit.need")).drop("fit")).withColumns({"u": F.least("unit_a", "unit_b"), "v": F.greatest("unit_a", "unit_b")})

    known = units.select("unit", T.name_facts(F.col("n")).alias("name"), "address")
    x, y = known.toDF("u", "name_u", "address_u"), known.toDF("v", "name_v", "address_v")
    scored = met.groupBy("u", "v").agg(F.min("need").alias("need")).join(x, "u").join(y, "v").where(T.facts_score(F.col("name_u"), F.col("name_v"), True) >= F.col("need") - 1e-9)
    scored = scored.select("u", "v", T.facts_score(F.col("name_u"), F.col("name_v")).alias("s"), T.gram_similarity(F.col("address_u"), F.col("address_v"), 2).alias("r"), "need")
    alike = materialize(scored.where(F.col("s") >= F.col("need") - 1e-9).drop("need"), "alike")
    score = sure_score(F.col("equal"), F.col("shape_a").bitwiseAND(F.col("shape_b")), F.col("s"), F.col("r"))
    found = materialize(met.join(alike, ["u", "v"]).where(F.col("s") >= F.col("need") - 1e-9).select("equal", "rep_a", "rep_b", score.alias("score")).where(F.col("score") >= threshold), "found")

    both = found.select("equal", F.inline(F.array(F.struct(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other"), "score"), F.struct(F.col("rep_b").alias("rep"), F.col("rep_a").alias("other"), "score"))))
    others = both.groupBy("equal", "rep").agg(F.min_by(F.struct("other", "score"), "other").alias("o"))
    of_many = members.join(groups.where("size > 1"), group).select("equal", "rep", "id").join(others, ["equal", "rep"]).select(F.col("id").alias("rep_a"), F.col("o.other").alias("rep_b"), F.col("o.score").alias("score"))
    links = found.drop("equal").unionByName(of_many).where("rep_a <> rep_b")
    links = links.groupBy(F.least("rep_a", "rep_b").alias("id_a"), F.greatest("rep_a", "rep_b").alias("id_b")).agg(F.max("score").alias("score"))
    return links.unionByName(same)


def clusters(records: DataFrame, matches: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``(id, cluster)``: transitive over matches of at least ``threshold``; unmatched records are their own cluster."""
    comp = connected_components(matches.where(F.col("score") >= threshold), "id_a", "id_b")
    return records.select("id").join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def canonical_records(records: DataFrame, members: DataFrame) -> DataFrame:
    """One record a cluster: id by MD5, each attribute from the most complete record that has it, confidence by sources and size."""
    r = records.join(members, "id").withColumn("filled", F.size(F.filter(F.map_values("attributes"), lambda v: F.coalesce(v, F.lit("")) != "")))
    attrs = r.select("cluster", "id", "filled", F.explode("attributes").alias("k", "v")).where("v <> ''")
    best = attrs.groupBy("cluster", "k").agg(F.min_by("v", F.struct(-F.col("filled"), F.col("id"))).alias("v"))
    best = best.groupBy("cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    g = r.groupBy("cluster").agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("member_ids"), F.array_sort(F.collect_set("source_system")).alias("source_systems"), F.min_by("entity_type", "id").alias("entity_type"))
    n, s = F.size("member_ids"), F.size("source_systems")
    out = g.join(best, "cluster", "left")
    return out.select(F.substring(F.md5(F.array_join("member_ids", "_")), 1, 16).alias("resolved_id"), "entity_type", "attributes", "member_ids", "source_systems", F.least(F.lit(1.0), 0.5 + 0.1 * s + 0.05 * n).alias("confidence_score"))


def resolve(records: DataFrame, threshold: float = 0.75, strategies: Sequence[str] = ("soundex", "ngram")) -> DataFrame:
    """Standardise, block, score, cluster and merge."""
    clean = standardize(records)
    with scratch() as tables:
        members = materialize(clusters(clean, matching_pairs(clean, strategies, threshold), threshold), "members")
        tables.remove(members)
    return canonical_records(clean, members)


# Fixed values.
SYNC_SOURCES = ("crm", "kyc", "transactions", "watchlist")
LINK_CONFIDENCE, LINK_DEPTH = 0.85, 2


def sync(records: DataFrame, sources: Sequence[str] = SYNC_SOURCES, threshold: float = 0.75) -> DataFrame:
    """Resolved records of each source for itself, with what follows: a network of ``network_depth`` where sure enough, and always a risk score."""
    known = records.withColumn("entity_type", F.coalesce("entity_type", F.lit("individual")))
    out = None
    for s in sources:
        r = resolve(known.where(F.col("source_system") == s), threshold).withColumn("source", F.lit(s))
        out = r if out is None else out.unionByName(r)
    if out is None:
        raise ValueError("no sources are named")
    return out.withColumns({"network_depth": F.when(F.col("confidence_score") >= LINK_CONFIDENCE, LINK_DEPTH), "risk_scored": F.lit(True)})


def resolution_rate(n_input: DataFrame, resolved: DataFrame) -> DataFrame:
    a, b = n_input.agg(F.count("*").alias("input_count")), resolved.agg(F.count("*").alias("resolved_count"))
    return a.crossJoin(b).withColumn("resolution_rate", F.coalesce(1 - F.try_divide(F.col("resolved_count").cast("double"), F.col("input_count").cast("double")), F.lit(0.0)))  # one row each


def compare(pairs: DataFrame, a: str = "name_a", b: str = "name_b") -> DataFrame:
    """Seven scores of two names, and what they suggest."""
    x, y = F.col(a), F.col(b)
    s = pairs.withColumns({"jaro": T.jaro(x, y), "jaro_winkler": T.jaro_winkler(x, y), "levenshtein": T.levenshtein_similarity(x, y), "jaccard": T.gram_similarity(x, y, 3), "token": T.token_similarity(x, y), "phonetic": T.phonetic_similarity(x, y), "composite": T.name_score(x, y)})
    c = F.col("composite")
    return s.withColumn("recommendation", F.when(c >= 0.8, "likely_match").when(c >= 0.6, "possible_match").otherwise("unlikely_match"))


def lookup_names(names: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """Entities whose name contains each query name, the first ``most`` by id.

    A query meets only names that have its first three letters somewhere in a row; shorter
    queries, of which there are few different ones, meet names by their one or two letters.
    """
    q = names.select(F.col("name").alias("query")).where("query <> ''").distinct().withColumn("low", F.lower("query"))
    q = q.withColumn("gram", F.substring("low", 1, 3))
    e = entities.select("id", "name", F.lower("name").alias("text")).where("text <> ''")
    at = F.sequence(F.lit(1), F.length("text"))
    grams = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*[F.substring(F.col("text"), i, F.lit(n)) for n in (1, 2, 3)]))))
    hit = e.withColumn("gram", F.explode(grams)).join(q, "gram").where(F.col("text").contains(F.col("low")))
    top = hit.withColumn("k", F.row_number().over(W.partitionBy("query").orderBy("id"))).where(F.col("k") <= most)
    return top.select("query", "id", "name", F.lit(0.9).alias("confidence"))
