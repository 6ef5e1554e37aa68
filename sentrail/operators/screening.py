"""Watch-list screening of names against pattern lists, and fuzzy screening against the sanctioned entities."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, release

# Fixed values: (provider, all of these parts, list type, confidence, score).
PATTERNS = (
    ("provider_1", ("kim", "jong"), "sanctions", "strong", 0.92), ("provider_1", ("putin",), "sanctions", "strong", 0.95), ("provider_1", ("putin",), "pep", "exact", 1.0),
    ("provider_1", ("minister|senator|president|governor",), "pep", "potential", 0.65), ("provider_2", ("fraud|scandal|corrupt",), "adverse_media", "medium", 0.70), ("provider_2", ("sec|violation",), "enforcement", "potential", 0.55),
)


def holds(low: Column, parts: Sequence[str]) -> Column:
    """Whether a lower-case text has one alternative of each part."""
    out = F.lit(True)
    for p in parts:
        any_of = F.lit(False)
        for x in p.split("|"):
            any_of = any_of | low.contains(x)
        out = out & any_of
    return out


Pattern = tuple[str, tuple[str, ...], str, str, float]


def matches(names: DataFrame, providers: Sequence[str] = ("provider_1", "provider_2"), list_types: Sequence[str] | None = None, patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """``names`` with ``matches``: highest score first, in provider order among equals; no join is needed for a fixed list.

    Another provider is a row of ``patterns`` under a name of its own. Each name is folded to
    lower case once.
    """
    n = F.col("__low")
    rows = [F.when(holds(n, parts), F.struct((-F.lit(score)).alias("o"), F.lit(i).alias("i"), F.lit(p).alias("provider"), F.lit(kind).alias("list_type"), F.lit(conf).alias("confidence"), F.lit(score).alias("score"))) for i, (p, parts, kind, conf, score) in enumerate(patterns) if p in providers and (list_types is None or kind in list_types)]
    none = F.array().cast("array<struct<o double, i int, provider string, list_type string, confidence string, score double>>")
    found = F.array_sort(F.array_compact(F.array(*rows))) if rows else none
    low = names.withColumn("__low", F.lower(F.coalesce("name", F.lit(""))))
    return low.withColumn("matches", F.transform(found, lambda m: F.struct(m["provider"], m["list_type"], m["confidence"], m["score"]))).drop("__low")


def alternatives(parts: Sequence[str]) -> list[tuple[str, ...]]:
    """A pattern's parts with each choice of their alternatives."""
    return list(itertools.product(*[p.split("|") for p in parts]))


def matches_in(names: DataFrame, entries: DataFrame) -> DataFrame:
    """``names`` (id, name) with ``matches``, highest score first, from list entries ``(provider, parts, list_type, confidence, score)``.

    An entry fits a name that holds all its parts, letter case aside; of entries alike in all but their parts one counts. Both
    sides may be large: distinct names meet distinct sets of parts, by the first letters of the longest part, at most three, so a name meets
    only entries that share a piece with it; what the entries say comes once for each set. Entries without parts fit nothing.
    """
    e = entries.withColumn("parts", F.array_sort(F.array_distinct(F.filter(F.transform("parts", F.lower), lambda p: p != "")))).where("size(parts) > 0")
    says = ("provider", "list_type", "confidence", "score")
    e = e.groupBy("parts").agg(F.collect_set(F.struct((-F.col("score")).alias("o"), *says)).alias("says"))
    longest = F.element_at(F.array_sort(F.transform("parts", lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), 1)["p"]
    e = e.withColumn("piece", F.substring(longest, 1, 3))
    sizes = [r[0] for r in e.select(F.length("piece")).distinct().collect()]  # 1, 2 or 3
    n = names.withColumn("__low", F.lower(F.coalesce("name", F.lit(""))))
    at = lambda k: F.when(F.length("__low") >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("__low") - k + 1)), lambda i: F.substring(F.col("__low"), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    pieces = F.array_distinct(F.concat(F.array().cast("array<string>"), *[at(k) for k in sizes]))
    hit = n.select("__low").distinct().select("__low", F.explode(pieces).alias("piece")).join(e, "piece").where(F.forall("parts", lambda p: F.col("__low").contains(p)))
    found = hit.select("__low", F.explode("says").alias("s")).distinct().groupBy("__low").agg(F.array_sort(F.collect_list("s")).alias("found"))
    none = F.array().cast("array<struct<provider:string,list_type:string,confidence:string,score:double>>")
    out = n.join(found, "__low", "left").drop("__low")
    return out.withColumn("matches", F.coalesce(F.transform("found", lambda m: F.struct(m["provider"], m["list_type"], m["confidence"], m["score"])), none)).drop("found")


def match_records(screened: DataFrame) -> DataFrame:
    """One row for each match of ``(id, name, matches)``, with an id and the fields that a list entry may leave open."""
    m = screened.select("id", F.col("name").alias("query_name"), F.posexplode("matches").alias("pos", "m"))
    empty = F.array().cast("array<string>")
    key = F.concat_ws("_", F.col("m.provider"), F.col("m.list_type"), F.col("query_name"), F.col("m.confidence"))
    return m.select(
        F.substring(F.md5(key), 1, 16).alias("match_id"), "id", "query_name", F.col("m.provider").alias("list_source"), "m.list_type", "m.confidence", F.col("m.score").alias("match_score"),
        (F.col("pos") == 0).alias("is_highest"), F.lit("").alias("list_entry_id"), *[empty.alias(c) for c in ("matched_aliases", "sanctions_programs", "pep_positions", "categories", "risk_flags")],
    )


def action(m: Column) -> Column:
    has = lambda kind, *conf: F.exists(m, lambda x: (x["list_type"] == kind) & (x["confidence"].isin(*conf) if conf else F.lit(True)))
    return (
        F.when(F.size(m) == 0, "clear").when(has("sanctions", "exact"), "reject_sanctions_exact").when(has("sanctions", "strong"), "escalate_sanctions").when(has("sanctions"), "review_sanctions")
        .when(has("pep", "exact", "strong"), "enhanced_due_diligence").when(has("pep"), "review_pep").when(has("adverse_media"), "review_media").otherwise("review")
    )


def screen(names: DataFrame, providers: Sequence[str] = ("provider_1", "provider_2"), list_types: Sequence[str] | None = None) -> DataFrame:
    s = matches(names, providers, list_types)
    m = F.col("matches")
    kind = lambda k: F.exists(m, lambda x: x["list_type"] == k)
    return s.withColumns({"match_count": F.size(m), "highest_score": F.coalesce(F.get(m, F.lit(0))["score"], F.lit(0.0)), "is_sanctioned": kind("sanctions"), "is_pep": kind("pep"), "recommended_action": action(m)})


def screening_alerts(screened: DataFrame) -> DataFrame:
    return screened.where("recommended_action <> 'clear'")


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\W+"), lambda t: t != ""))


def close(a: Column, b: Column) -> Column:
    """Within 0 edits for up to 2 letters, 1 for up to 5, else 2, by the query's length."""
    allowed = F.when(F.length(a) <= 2, 0).when(F.length(a) <= 5, 1).otherwise(2)
    return F.levenshtein(a, b) <= allowed


def fuzzy_hits(entities: DataFrame, query: str, name: str = "name") -> DataFrame:
    """Entities with the share of the query's words that a word of theirs is close to; only those with any."""
    q = tokens(F.lit(query))
    n = F.size(F.filter(q, lambda x: F.exists(tokens(F.col(name)), lambda t: close(x, t))))
    return entities.withColumn("match_score", F.coalesce(F.try_divide(n.cast("double"), F.size(q).cast("double")), F.lit(0.0))).where("match_score > 0")


def screen_index(entities: DataFrame, query: str, threshold: float = 0.8, limit: int = 10) -> DataFrame:
    """Sanctioned entities whose score is at least ``threshold`` of the best one's."""
    hits = fuzzy_hits(entities.where("is_sanctioned = 1"), query)
    best = hits.agg(F.max("match_score").alias("best"))
    return hits.crossJoin(F.broadcast(best)).where(F.col("match_score") >= threshold * F.col("best")).drop("best").orderBy(F.desc("match_score"), "id").limit(limit)  # best is one row


def sync_list(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Replace a stored watch list and return it; ``rows`` may themselves be read from ``path``."""
    new = materialize(rows, "watch-list")
    new.write.mode("overwrite").parquet(path)
    release(new)
    return spark.read.parquet(path)


def to_rescreen(entities: DataFrame, old_names: DataFrame, new_names: DataFrame) -> DataFrame:
    """Entities whose name a synced list now has and had not before."""
    added = new_names.select(F.lower("name").alias("low")).distinct().join(old_names.select(F.lower("name").alias("low")).distinct(), "low", "left_anti")
    return entities.withColumn("low", F.lower("name")).join(added, "low", "left_semi").drop("low")
