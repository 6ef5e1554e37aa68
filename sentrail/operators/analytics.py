"""Dashboards, trends and filtered lists, each from one pass over its table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ordinal, ratio
from ..functions.segments import numbered

BUCKETS = (("very_low", 0.0, 0.2), ("low", 0.2, 0.4), ("medium", 0.4, 0.6), ("high", 0.6, 0.8), ("critical", 0.8, 1.0))


def since(c: str, as_of: datetime, days: int) -> Column:
    return F.col(c) >= F.lit(as_of) - F.expr(f"interval {int(days)} days")


def risk_distribution(entities: DataFrame) -> DataFrame:
    """Entities by risk bucket, the last one closed; every bucket has a row."""
    r = F.col("risk_score")
    cells = [F.count_if((r >= lo) & ((r <= hi) if hi == 1.0 else (r < hi))).alias(n) for n, lo, hi in BUCKETS]
    counts = entities.agg(*cells)
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("bucket"), F.lit(lo).alias("min_score"), F.lit(hi).alias("max_score"), F.col(n).alias("entity_count")) for n, lo, hi in BUCKETS])))


def transaction_trends(tx: DataFrame, as_of: datetime, days: int = 30, granularity: str = "day") -> DataFrame:
    t = tx.where(since("transaction_date", as_of, days)).groupBy(F.date_trunc(granularity, "transaction_date").alias("period"))
    return t.agg(F.count("*").alias("transaction_count"), F.sum("amount").alias("total_amount"), F.avg("risk_score").alias("avg_risk")).orderBy("period")


def alert_rules(alerts: DataFrame, as_of: datetime, days: int = 30, limit: int = 10) -> DataFrame:
    g = alerts.where(since("detected_at", as_of, days)).groupBy("rule_name").agg(F.count("*").alias("alert_count"), F.avg("confidence_score").alias("avg_confidence"))
    return g.orderBy(F.desc("alert_count"), "rule_name").limit(limit)


def alert_categories(alerts: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return alerts.where(since("detected_at", as_of, days)).groupBy("category").agg(F.count("*").alias("alert_count"))


def high_risk_entities(entities: DataFrame, limit: int = 20) -> DataFrame:
    return entities.orderBy(F.desc_nulls_last("risk_score"), "id").limit(limit)


def network_statistics(entities: DataFrame, tx: DataFrame) -> DataFrame:
    e = entities.agg(F.count("*").alias("total_entities"))
    t = tx.agg(F.count("*").alias("total_transactions"), F.countDistinct("sender_entity_id").alias("unique_senders"), F.countDistinct("receiver_entity_id").alias("unique_receivers"))
    return e.crossJoin(t)  # one row each


def entities_by_type(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count("*").alias("entity_count"))


def transaction_stats(tx: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    s = tx.where(since("transaction_date", as_of, days)).agg(
        F.count("*").alias("total_count"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_amount"), F.count_if(F.col("is_flagged") == 1).alias("flagged_count"),
        F.coalesce(F.avg("risk_score"), F.lit(0.0)).alias("avg_risk"), F.count_if(F.col("risk_score") >= 0.7).alias("high_risk_count"),
    )
    return s.withColumn("flag_rate", F.coalesce(ratio(F.col("flagged_count"), F.col("total_count")), F.lit(0.0)))


def breakdown(df: DataFrame, members: dict[str, Sequence[str]], totals: dict[str, Column] | None = None) -> DataFrame:
    """``(dimension, member, row_count)``: rows per enum member of several columns, zeros included, and rows that meet a condition, in one pass."""
    cells = [(c, m, F.col(c) == m) for c, values in members.items() for m in values] + [("total", k, v) for k, v in (totals or {}).items()]
    counts = df.agg(*[F.count_if(cond).alias(f"n{i}") for i, (_, _, cond) in enumerate(cells)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("dimension"), F.lit(m).alias("member"), F.col(f"n{i}").alias("row_count")) for i, (c, m, _) in enumerate(cells)])))


def alert_dashboard(alerts: DataFrame, statuses: Sequence[str], severities: Sequence[str]) -> DataFrame:
    return breakdown(alerts, {"status": statuses, "severity": severities}, {"open": F.col("status").isin("new", "investigating")})


def case_dashboard(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("open", "in_progress", "pending_review")).alias("open_cases"), F.count_if(F.col("status") == "sar_filed").alias("sar_count"), F.avg("overall_risk_score").alias("avg_risk"))


ACTIVE = ("draft", "in_progress", "review")


def proposal_dashboard(p: DataFrame, as_of: datetime) -> DataFrame:
    active, won, lost = F.col("status").isin(*ACTIVE), F.col("status") == "won", F.col("status") == "lost"
    soon = F.col("due_date") <= F.lit(as_of) + F.expr("interval 7 days")  # what is overdue counts too
    a = p.agg(F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(active & soon).alias("due_soon"), F.count_if(won).alias("won"), F.count_if(lost).alias("lost"), F.coalesce(F.sum(F.when(won, F.col("estimated_deal_value"))), F.lit(0.0)).alias("won_value"))
    return a.withColumn("win_rate", F.coalesce(F.round(ratio(F.col("won") * 100, F.col("won") + F.col("lost")), 1), F.lit(0.0)))


def win_loss(p: DataFrame, as_of: datetime, months: int = 12, by: str = "solution_area") -> DataFrame:
    """Won and lost proposals by solution area (exploded) or industry (null or empty is 'Unknown')."""
    d = p.where(since("decision_date", as_of, 30 * months) & F.col("status").isin("won", "lost"))
    key = F.explode("solution_areas") if by == "solution_area" else F.coalesce(F.nullif(F.col("client_industry"), F.lit("")), F.lit("Unknown"))
    d = d.select(key.alias("group_key"), "status", "estimated_deal_value")
    won = F.col("status") == "won"
    return d.groupBy("group_key").agg(F.count_if(won).alias("won"), F.count_if(~won).alias("lost"), F.sum(F.when(won, F.col("estimated_deal_value")).otherwise(0.0)).alias("won_value"), F.sum(F.when(~won, F.col("estimated_deal_value")).otherwise(0.0)).alias("lost_value"))


def engagement_dashboard(e: DataFrame) -> DataFrame:
    """Engagements with their success rate among those that ended."""
    s = F.col("status")
    a = e.agg(F.count("*").alias("total"), F.count_if(s == "successful").alias("successful"), F.count_if(s.isin("completed", "successful", "unsuccessful")).alias("ended"))
    return a.withColumn("success_rate", F.coalesce(F.round(ratio(F.col("successful") * 100, F.col("ended")), 1), F.lit(0.0)))


def demo_dashboard(d: DataFrame, as_of: datetime) -> DataFrame:
    return d.agg(F.count("*").alias("total"), F.count_if((F.col("scheduled_at") >= F.lit(as_of)) & (F.col("status") == "scheduled")).alias("upcoming"), F.avg("rating").alias("avg_rating"))


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one row with total and pages); ``order`` must end in a unique column."""
    total = df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size), total


#: A column, and how a list is ordered by it: descending, nulls first.
Sort = tuple[str, bool, bool]


def sorted_by(order: Sequence[Sort]) -> list[Column]:
    return [getattr(F.col(c), f"{'desc' if down else 'asc'}_nulls_{'first' if first else 'last'}")() for c, down, first in order]


def page_after(df: DataFrame, order: Sequence[Sort], after: Mapping[str, object] | None = None, size: int = 20) -> DataFrame:
    """The ``size`` rows that follow the row with the values ``after`` (the first ones without); ``order`` must end in a unique column.

    Each task keeps ``size`` rows at most, on whatever page, and rows before the key are filtered where they are read.
    """
    if after is not None:
        later, equal = F.lit(False), F.lit(True)
        for c, down, first in order:
            v = after[c]
            if v is None:
                here, same = (F.col(c).isNotNull() if first else F.lit(False)), F.col(c).isNull()
            else:
                here, same = (F.col(c) < F.lit(v) if down else F.col(c) > F.lit(v)), F.col(c) == F.lit(v)
                here = here if first else here | F.col(c).isNull()
            later, equal = later | (equal & here), equal & same
        lead, down, first = order[0]
        if after[lead] is not None and first:  # what all later rows meet, for the scan
            df = df.where(F.col(lead) <= F.lit(after[lead]) if down else F.col(lead) >= F.lit(after[lead]))
        df = df.where(later)
    return df.orderBy(*sorted_by(order)).limit(size)


def page_starts(df: DataFrame, order: Sequence[Sort], size: int = 20) -> DataFrame:
    """``(page, ...)`` with the sort columns of the last row before each page from the second on: the keys for ``page_after``.

    Rows are numbered by range partitions and carried counts, not in one task.
    """
    rows = df.select(*[c for c, _, _ in order])
    rows = numbered(rows, sorted_by(order), "__n")
    return rows.where(F.col("__n") % size == 0).withColumn("page", (F.col("__n") / size).cast("long") + 1).drop("__n")


def matching(df: DataFrame, equal: dict | None = None, at_least: dict | None = None, at_most: dict | None = None, like: dict | None = None, any_like: tuple[Sequence[str], str] | None = None) -> DataFrame:
    """Rows that meet all given conditions; conditions whose value is None are not applied.

    ``like`` is a case-blind substring whose wildcards stay wild; ``any_like`` asks it of any of several columns.
    """
    for c, v in (equal or {}).items():
        if v is not None:
            df = df.where(F.col(c) == v)
    for c, v in (at_least or {}).items():
        if v is not None:
            df = df.where(F.col(c) >= v)
    for c, v in (at_most or {}).items():
        if v is not None:
            df = df.where(F.col(c) <= v)
    for c, v in (like or {}).items():
        if v is not None:
            df = df.where(F.col(c).ilike(f"%{v}%"))
    if any_like and any_like[1]:
        cond = F.lit(False)
        for c in any_like[0]:
            cond = cond | F.coalesce(F.col(c).ilike(f"%{any_like[1]}%"), F.lit(False))
        df = df.where(cond)
    return df


def list_transactions(tx: DataFrame, number: int = 1, size: int = 20, transaction_type: str | None = None, min_amount: float | None = None, max_amount: float | None = None, currency: str | None = None, sender_country: str | None = None, receiver_country: str | None = None, is_flagged: bool | None = None, min_risk: float | None = None, date_from: datetime | None = None, date_to: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    up = lambda s: s and s.upper()
    rows = matching(tx, {"transaction_type": transaction_type, "currency": up(currency), "sender_country": up(sender_country), "receiver_country": up(receiver_country), "is_flagged": None if is_flagged is None else int(is_flagged)}, {"amount": min_amount, "risk_score": min_risk})
    rows = matching(rows, at_most={"amount": max_amount})
    rows = matching(rows, at_least={"transaction_date": date_from}, at_most={"transaction_date": date_to})
    return page(rows, [F.desc_nulls_first("transaction_date"), F.col("id")], number, size)


def list_alerts(alerts: DataFrame, severities: Sequence[str], number: int = 1, size: int = 20, date_from: datetime | None = None, date_to: datetime | None = None, **equal: object) -> tuple[DataFrame, DataFrame]:
    rows = matching(alerts, equal, {"detected_at": date_from}, {"detected_at": date_to})
    return page(rows, [F.desc_nulls_first(ordinal(F.col("severity"), severities)), F.desc_nulls_first("detected_at"), F.col("id")], number, size)


def list_cases(cases: DataFrame, number: int = 1, size: int = 20, priority: int | None = None, **equal: object) -> tuple[DataFrame, DataFrame]:
    return page(matching(cases, equal | {"priority": priority or None}), [F.asc_nulls_last("priority"), F.desc_nulls_first("opened_at"), F.col("id")], number, size)


def list_entities(entities: DataFrame, number: int = 1, size: int = 20, entity_type: str | None = None, min_risk: float | None = None, max_risk: float | None = None, is_sanctioned: bool | None = None, is_pep: bool | None = None, search: str | None = None) -> tuple[DataFrame, DataFrame]:
    flag = lambda b: None if b is None else int(b)
    rows = matching(entities, {"entity_type": entity_type, "is_sanctioned": flag(is_sanctioned), "is_pep": flag(is_pep)}, {"risk_score": min_risk}, {"risk_score": max_risk}, {"name": search or None})
    return page(rows, [F.desc_nulls_first("risk_score"), F.col("id")], number, size)


def list_proposals(p: DataFrame, priorities: Sequence[str], number: int = 1, size: int = 20, client: str | None = None, due_before: datetime | None = None, search: str | None = None, search_in: Sequence[str] = ("title", "client_name", "description"), **equal: object) -> tuple[DataFrame, DataFrame]:
    rows = matching(p, equal, at_most={"due_date": due_before}, like={"client_name": client}, any_like=(search_in, search or ""))
    return page(rows, [F.asc_nulls_last("due_date"), F.desc_nulls_first(ordinal(F.col("priority"), priorities)), F.col("id")], number, size)


def list_engagements(e: DataFrame, number: int = 1, size: int = 20, client: str | None = None, search: str | None = None, **equal: object) -> tuple[DataFrame, DataFrame]:
    """Engagements by type and status, newest first."""
    rows = matching(e, equal, like={"client_name": client or None}, any_like=(("title", "client_name"), search or ""))
    return page(rows, [F.desc_nulls_first("created_at"), F.col("id")], number, size)


def list_demos(d: DataFrame, number: int = 1, size: int = 20, client: str | None = None, date_from: datetime | None = None, date_to: datetime | None = None, **equal: object) -> tuple[DataFrame, DataFrame]:
    """Demos by type, status and presenter, latest date first."""
    rows = matching(d, equal, {"scheduled_at": date_from}, {"scheduled_at": date_to}, {"client_name": client or None})
    return page(rows, [F.desc_nulls_first("scheduled_at"), F.col("id")], number, size)


def list_scenarios(s: DataFrame, number: int = 1, size: int = 20, search: str | None = None, **equal: object) -> tuple[DataFrame, DataFrame]:
    """Active demo scenarios, the most used first."""
    rows = matching(s, {"is_active": 1} | equal, any_like=(("name", "description"), search or ""))
    return page(rows, [F.desc_nulls_first("times_used"), F.col("id")], number, size)


def list_content(c: DataFrame, number: int = 1, size: int = 20, search: str | None = None, **equal: object) -> tuple[DataFrame, DataFrame]:
    """Current library content, the most used first."""
    rows = matching(c, {"is_current": 1} | equal, any_like=(("title", "content"), search or ""))
    return page(rows, [F.desc_nulls_first("usage_count"), F.col("id")], number, size)


def sections(s: DataFrame, proposal: object) -> DataFrame:
    """A proposal's sections by number, as text."""
    return s.where(F.col("proposal_id") == proposal).orderBy(F.col("section_number").cast("string"), "id")


def related_transactions(tx: DataFrame, transaction: object, limit: int = 10) -> DataFrame:
    """Other payments that share a party with one, in any role, newest first; parties are joined by equality."""
    parties = tx.where(F.col("id") == transaction).select(F.explode(F.array("sender_entity_id", "receiver_entity_id")).alias("party")).where("party is not null").distinct()
    others = tx.where(F.col("id") != transaction)
    sent = others.join(F.broadcast(parties), others["sender_entity_id"] == F.col("party"), "left_semi")  # at most two parties
    got = others.join(F.broadcast(parties), others["receiver_entity_id"] == F.col("party"), "left_semi")
    return sent.unionByName(got).dropDuplicates(["id"]).orderBy(F.desc("transaction_date"), "id").limit(limit)


def recalculated_risk(entities: DataFrame, tx: DataFrame, alerts: DataFrame) -> DataFrame:
    """Risk of every entity from its flags and its numbers of payments and alerts."""
    parties = tx.select(F.array_distinct(F.array("sender_entity_id", "receiver_entity_id")).alias("p")).select(F.explode("p").alias("id")).groupBy("id").agg(F.count("*").alias("tx_count"))
    al = alerts.groupBy(F.col("primary_entity_id").alias("id")).agg(F.count("*").alias("alert_count"))
    e = entities.join(parties, "id", "left").join(al, "id", "left").na.fill(0, ["tx_count", "alert_count"])
    c = F.col
    raw = F.when(c("is_sanctioned") == 1, 0.4).otherwise(0.0) + F.when(c("is_pep") == 1, 0.2).otherwise(0.0) + F.when(c("is_adverse_media") == 1, 0.15).otherwise(0.0) + F.when(c("tx_count") > 100, 0.1).otherwise(0.0) + F.least(F.lit(0.15), c("alert_count") * 0.03)
    return e.select("id", "tx_count", "alert_count", F.round(F.least(F.lit(1.0), raw), 6).alias("new_risk"))


def pattern_summary(tx: DataFrame, entity: object, lookback_days: int, as_of: datetime, limit: int | None = 10000) -> DataFrame:
    """One row over an entity's recent payments (the newest ``limit``, if there is one): totals, distinct counterparties and the limits they exceed."""
    own = tx.where((F.col("sender_entity_id") == entity) | (F.col("receiver_entity_id") == entity)).where(since("transaction_date", as_of, lookback_days))
    if limit is not None:
        own = own.orderBy(F.desc("transaction_date"), "id").limit(limit)
    other = F.when(F.col("sender_entity_id") == entity, F.col("receiver_entity_id")).otherwise(F.col("sender_entity_id"))
    s = own.agg(F.count("*").alias("total_count"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_volume"), F.avg("amount").alias("avg_amount"), F.countDistinct(other).alias("counterparties"))
    return s.withColumns({"high_volume": F.col("total_volume") > 1_000_000, "high_frequency": F.col("total_count") > 1000, "many_counterparties": F.col("counterparties") > 100})


def tallies(tx: DataFrame, entity: object, columns: Sequence[str] = ("currency", "transaction_type")) -> DataFrame:
    """``(dimension, member, row_count)`` of an entity's payments, in one pass."""
    own = tx.where((F.col("sender_entity_id") == entity) | (F.col("receiver_entity_id") == entity))
    cells = own.select(F.inline(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("member")) for c in columns])))
    return cells.groupBy("dimension", "member").agg(F.count("*").alias("row_count"))


def first_counterparties(tx: DataFrame, entity: object, limit: int = 50) -> DataFrame:
    """The first counterparties that an entity meets, going back from its newest payment."""
    other = F.when(F.col("sender_entity_id") == entity, F.col("receiver_entity_id")).otherwise(F.col("sender_entity_id"))
    own = tx.where((F.col("sender_entity_id") == entity) | (F.col("receiver_entity_id") == entity))
    seen = own.select(other.alias("counterparty"), "transaction_date", "id").where("counterparty is not null")
    met = seen.groupBy("counterparty").agg(F.max(F.struct("transaction_date", (-F.col("id")).alias("o"))).alias("at"))
    return met.orderBy(F.desc("at"), "counterparty").limit(limit).select("counterparty")


def business_keys(df: DataFrame, prefix: str, date: str, form: str = "yyyyMM", width: int = 4, existing: int = 0) -> DataFrame:
    """Consecutive keys PREFIX-<date>-<number>; numbers follow (date, id) within each period."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(F.date_format(date, form)).orderBy(date, "id")) + existing
    return df.withColumn("business_key", F.concat_ws("-", F.lit(prefix), F.date_format(date, form), F.lpad(n.cast("string"), width, "0")))
