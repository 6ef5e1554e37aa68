"""State changes of transactions, alerts, cases, proposals, engagements and demos, as column updates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Alert routing by type, and days that kinds of records are kept.
ROUTES = {
    "high_risk_entity": ("high", "risk"), "high_risk_network": ("high", "network"), "watchlist_match": ("critical", "compliance"),
    "suspicious_transaction": ("high", "transaction"), "pep_match": ("medium", "compliance"), "sanctions_match": ("critical", "compliance"),
}
RETENTION_DAYS = {"jobs": 30, "logs": 7, "alerts": 365}


def change(df: DataFrame, ids: list, **columns: Column | object) -> DataFrame:
    """The named columns of the rows with these ids set."""
    hit = F.col("id").isin(ids)
    return df.withColumns({k: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(k)) for k, v in columns.items()})


def flag_transaction(tx: DataFrame, ids: list) -> DataFrame:
    return change(tx, ids, is_flagged=1)


def assign_alert(alerts: DataFrame, ids: list, to: str) -> DataFrame:
    return change(alerts, ids, assigned_to=to, status=F.when(F.col("status") == "new", "investigating").otherwise(F.col("status")))


def resolve_alert(alerts: DataFrame, ids: list, resolution: str) -> DataFrame:
    return change(alerts, ids, status={"sar": "resolved_sar", "false_positive": "resolved_false_positive"}.get(resolution, "closed"))


def escalate_alert(alerts: DataFrame, ids: list) -> DataFrame:
    return change(alerts, ids, status="escalated")


def assign_case(cases: DataFrame, ids: list, to: str) -> DataFrame:
    return change(cases, ids, assigned_to=to, status=F.when(F.col("status") == "open", "in_progress").otherwise(F.col("status")))


def file_sar(cases: DataFrame, ids: list) -> DataFrame:
    return change(cases, ids, status="sar_filed", sar_filed=1)


def close_case(cases: DataFrame, ids: list, action: bool) -> DataFrame:
    return change(cases, ids, status="closed" if action else "closed_no_action")


def proposal_status(p: DataFrame, ids: list, event: str) -> DataFrame:
    """'submit', 'won', 'lost' or 'delete' (which withdraws)."""
    states = {"submit": "submitted", "delete": "withdrawn", "won": "won", "lost": "lost"}
    if event not in states:
        raise ValueError(f"a proposal has no event {event!r}")
    return change(p, ids, status=states[event])


def change_engagement(e: DataFrame, ids: list, event: str) -> DataFrame:
    """'start' puts engagements in progress; any other event is the outcome they end with."""
    return change(e, ids, status="in_progress" if event == "start" else event)


def complete_demo(d: DataFrame, ids: list, rating: int | None = None) -> DataFrame:
    """Completed, with a new rating if one is given."""
    return change(d, ids, status="completed", **({"rating": rating} if rating else {}))


def add_note(df: DataFrame, ids: list, note: str, column: str = "investigation_notes") -> DataFrame:
    """``note`` on a line of its own after what is there."""
    return change(df, ids, **{column: F.concat_ws("\n", F.nullif(F.col(column), F.lit("")), F.lit(note))})


def bump(df: DataFrame, ids: list, counter: str) -> DataFrame:
    return change(df, ids, **{counter: F.coalesce(F.col(counter), F.lit(0)) + 1})


def next_version(version: Column) -> Column:
    """major.minor + 1."""
    p = F.split(version, r"\.")
    return F.concat_ws(".", F.get(p, F.lit(0)), (F.coalesce(F.get(p, F.lit(1)).cast("int"), F.lit(0)) + 1).cast("string"))


def route(alerts: DataFrame, kind: str = "alert_type") -> DataFrame:
    table = F.create_map(*[x for k, (p, c) in ROUTES.items() for x in (F.lit(k), F.struct(F.lit(p).alias("priority"), F.lit(c).alias("category")))])
    r = F.element_at(table, F.col(kind))
    return alerts.withColumns({"routed_priority": F.coalesce(r["priority"], F.lit("medium")), "routed_category": F.coalesce(r["category"], F.lit("other"))})


def expired(df: DataFrame, kind: str, at: str, as_of: datetime) -> DataFrame:
    return df.where(F.col(at) < F.lit(as_of) - F.expr(f"interval {RETENTION_DAYS[kind]} days"))


# Alert types of list matches, risk levels that raise an alert or due diligence, and its steps.
MATCH_ALERTS = {"sanctions": "sanctions_match", "pep": "pep_match"}
ALERTED, DILIGENCE = ("critical", "high"), ("medium",)
EXPOSED = 0.7
STEPS = (("network_analysis", {"depth": "4"}), ("transaction_analysis", {"lookback_days": "365", "include_counterparties": "true"}), ("adverse_media", {}), ("source_of_funds", {}), ("document_verification", {}))


def match_alerts(screened: DataFrame) -> DataFrame:
    """An alert, routed, for each match of screened names ``(id, name, matches)``; each row's alerts come from that row alone, so slices of any size give the same."""
    m = screened.select(F.col("id").alias("entity_id"), F.col("name").alias("matched_name"), F.explode("matches").alias("m"))
    table = F.create_map(*[F.lit(x) for kv in MATCH_ALERTS.items() for x in kv])
    kind = F.coalesce(F.element_at(table, F.col("m.list_type")), F.lit("watchlist_match"))
    return route(m.select("entity_id", "matched_name", kind.alias("alert_type"), F.col("m.score").alias("match_score"), F.col("m.provider").alias("watchlist")))


def score_alerts(scored: DataFrame) -> DataFrame:
    """A critical alert for each entity of a high or critical score."""
    hit = scored.where(F.col("risk_level").isin(*ALERTED))
    return hit.select(F.col("id").alias("entity_id"), F.lit("high_risk_entity").alias("alert_type"), F.lit("critical").alias("priority"), "overall_score", "risk_level")


def due_diligence(scored: DataFrame) -> DataFrame:
    """``(entity_id, step, task, options)``: what follows for each entity of a medium score, in order of ``step``."""
    options = lambda o: F.create_map(*[F.lit(x) for kv in o.items() for x in kv]).cast("map<string,string>")
    tasks = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(t).alias("task"), options(o).alias("options")) for i, (t, o) in enumerate(STEPS, 1)])
    return scored.where(F.col("risk_level").isin(*DILIGENCE)).select(F.col("id").alias("entity_id"), F.inline(tasks))


def exposure_alerts(metrics: DataFrame, threshold: float = EXPOSED) -> DataFrame:
    """A routed alert for each entity whose neighbours' risk (``network.node_metrics``) is above ``threshold``."""
    hit = metrics.where(F.col("risk_exposure") > threshold)
    return route(hit.select(F.col("id").alias("entity_id"), F.lit("high_risk_network").alias("alert_type"), "risk_exposure", "neighbour_count"))
