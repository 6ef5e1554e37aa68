"""Contextual risk scoring: rules give factors, factors a weighted mean."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .network import risk_level

# Scores by PEP level and by country.
PEP_SCORES = {"head_of_state": 1.0, "senior_government": 0.9, "international_org": 0.85, "domestic": 0.7, "foreign": 0.8, "family_associate": 0.6, "unknown": 0.75}
COUNTRY_SCORES = {"KP": 1.0, "IR": 1.0, "MM": 0.95, "SY": 0.95, "YE": 0.9, "AF": 0.8, "PK": 0.7, "VE": 0.7, "ZW": 0.7, "KY": 0.5, "VG": 0.5, "PA": 0.5, "BZ": 0.5}


def factor(category: str, name: str, weight: float, score: Column, fires: Column, indicators: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    s = F.struct(F.lit(category).alias("category"), F.lit(name).alias("name"), score.cast("double").alias("score"), F.lit(weight).alias("weight"), (indicators if indicators is not None else none).alias("indicators"))
    return F.when(fires, s)


def looked_up(table: dict[str, float], key: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), key)


def indicated(parts: Sequence[tuple[str, Column, Column | float]]) -> tuple[Column, Column, Column]:
    """(capped sum, whether any holds, names of those that hold)."""
    hold = [(n, F.coalesce(c, F.lit(False)), s if isinstance(s, Column) else F.lit(s)) for n, c, s in parts]
    total = sum((F.when(c, s).otherwise(0.0) for _, c, s in hold), F.lit(0.0))
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c, _ in hold]))
    return F.least(F.lit(1.0), total), F.size(names) > 0, names


def sanctions() -> Column:
    return factor("sanctions", "sanctions_match", 1.0, F.lit(1.0), F.coalesce(F.col("is_sanctioned"), F.lit(False)) | (F.coalesce(F.size("matched_sanctions_lists"), F.lit(0)) > 0))


def pep() -> Column:
    return factor("pep", "pep_status", 0.8, F.coalesce(looked_up(PEP_SCORES, F.coalesce("pep_level", F.lit("unknown"))), F.lit(0.75)), F.coalesce(F.col("is_pep"), F.lit(False)))


def jurisdiction() -> Column:
    c = F.upper(F.coalesce(F.nullif(F.col("country"), F.lit("")), F.col("jurisdiction")))
    score = looked_up(COUNTRY_SCORES, F.coalesce(c, F.lit("")))
    return factor("jurisdiction", "jurisdiction_risk", 0.6, score, score.isNotNull())


def transaction_pattern() -> Column:
    t = lambda f: F.col(f"transaction_stats.{f}")
    s, fires, names = indicated([
        ("high_volume", t("total_volume") > 1_000_000, 0.2), ("potential_structuring", t("structuring_indicator") > 0.7, 0.4), ("rapid_passthrough", t("passthrough_ratio") > 0.9, 0.3),
        ("round_amounts", t("round_amount_ratio") > 0.5, 0.1), ("high_cross_border", t("cross_border_ratio") > 0.7, 0.2), ("cash_intensive", t("cash_ratio") > 0.4, 0.2),
    ])
    return factor("transaction_pattern", "transaction_pattern", 0.7, s, fires, names)


def network_context() -> Column:
    n = lambda f: F.col(f"network.{f}")
    s, fires, names = indicated([
        ("high_risk_connections", n("high_risk_connections") > 0, F.least(F.lit(0.4), n("high_risk_connections") * 0.1)), ("sanctioned_connections", n("sanctioned_connections") > 0, F.least(F.lit(0.5), n("sanctioned_connections") * 0.2)),
        ("dense_network_cluster", n("clustering_coefficient") > 0.7, 0.15), ("high_network_centrality", n("centrality_score") > 0.8, 0.1), ("circular_transaction_flow", n("in_circular_flow"), 0.3),
        ("network_risk_exposure", n("propagated_risk") > 0.3, n("propagated_risk") * 0.5),
    ])
    return factor("network", "network_context", 0.8, s, fires, names)


def behavioural() -> Column:
    b = lambda f: F.col(f"behavioral.{f}")
    s, fires, names = indicated([("unusual_hours", b("off_hours_ratio") > 0.3, 0.15), ("activity_spike", b("activity_spike") > 3.0, 0.25), ("pattern_deviation", b("pattern_change_score") > 0.7, 0.2), ("dormant_reactivation", b("dormant_reactivation"), 0.3)])
    return factor("behavioral", "behavioral_anomaly", 0.6, s, fires, names)


Rule = Callable[[], Column]
DEFAULT_RULES: tuple[Rule, ...] = (sanctions, pep, jurisdiction, transaction_pattern, network_context, behavioural)

ENTITY = "id string, name string, entity_type string, country string, jurisdiction string, is_sanctioned boolean, is_pep boolean, pep_level string, matched_sanctions_lists array<string>"
NETWORK = "struct<high_risk_connections int, sanctioned_connections int, clustering_coefficient double, centrality_score double, in_circular_flow boolean, propagated_risk double>"
STATS = "struct<total_volume double, structuring_indicator double, passthrough_ratio double, round_amount_ratio double, cross_border_ratio double, cash_ratio double>"
BEHAVIOUR = "struct<off_hours_ratio double, activity_spike double, pattern_change_score double, dormant_reactivation boolean>"


def with_context(entities: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Entities with the columns the rules read; what neither table has is null."""
    if context is not None:
        entities = entities.join(context, "id", "left")
    wanted = {"jurisdiction": "string", "pep_level": "string", "matched_sanctions_lists": "array<string>", "network": NETWORK, "transaction_stats": STATS, "behavioral": BEHAVIOUR}
    return entities.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in entities.columns})


def score(entities: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """``factors``, ``overall_score`` (weighted mean over the rules that fired) and ``risk_level`` for each entity."""
    f = entities.withColumn("factors", F.array_compact(F.array(*[r() for r in rules])))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    total = F.aggregate("factors", zero, lambda a, x: F.struct((a["s"] + x["score"] * x["weight"]).alias("s"), (a["w"] + x["weight"]).alias("w")))
    mean = F.coalesce(F.try_divide(total["s"], total["w"]), F.lit(0.0))
    f = f.withColumn("overall_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)))
    return f.withColumn("risk_level", risk_level(F.round("overall_score", 12)))


# Fixed values.
RECOMMENDATIONS = {"sanctions": "Immediate escalation required - sanctions match", "network": "Review network connections for risk exposure", "transaction_pattern": "Detailed transaction analysis recommended"}


def explain(scored: DataFrame) -> DataFrame:
    """Factors by falling contribution, and recommendations for strong ones in that order."""
    parts = F.transform("factors", lambda x, i: F.struct((-x["score"] * x["weight"]).alias("o"), i.alias("i"), x["category"].alias("category"), x["name"].alias("name"), F.round(x["score"], 3).alias("score"), F.round(x["score"] * x["weight"], 3).alias("contribution")))
    parts = F.array_sort(parts)
    strong = F.filter(parts, lambda x: F.get(F.col("factors"), x["i"])["score"] >= 0.8)
    strong = F.filter(strong, lambda x: x["category"].isin(*RECOMMENDATIONS))
    table = F.create_map(*[F.lit(x) for kv in RECOMMENDATIONS.items() for x in kv])
    return scored.withColumns({"explanation": F.transform(parts, lambda p: F.struct(p["category"], p["name"], p["score"], p["contribution"])), "recommendations": F.transform(strong, lambda x: F.element_at(table, x["category"]))})


def batch_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("total"), F.count_if(F.col("risk_level").isin("high", "critical")).alias("high_risk"), F.avg("overall_score").alias("avg_score"))
