"""Customer 360: survivorship, nested aggregation and data quality over source records of a customer.

``records`` has customer_id, pos (input order), source_system, updated_at and scalar
columns; nested arrays are columns of arrays of structs.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .network import risk_level

# Fixed values.
PRIORITY = {"kyc_system": 1, "core_banking": 2, "crm": 3, "trade_system": 4, "external_data": 5}
REQUIRED = {"name": 1.0, "date_of_birth": 0.8, "nationality": 0.6, "address": 0.7, "phone": 0.5, "email": 0.5, "identification": 0.9, "occupation": 0.4, "employer": 0.3}
QUALITY = {"completeness": 0.2, "accuracy": 0.25, "consistency": 0.2, "timeliness": 0.1, "uniqueness": 0.15, "validity": 0.1}
BY_PRIORITY = ("name", "date_of_birth", "nationality", "national_id")
BY_RECENCY = ("address", "phone", "email")


def priority() -> Column:
    table = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return F.coalesce(F.element_at(table, F.col("source_system")), F.lit(99))


def golden(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One value a field: identity fields by source priority, contact fields from the latest record, others by priority."""
    out = []
    for f in fields:
        order = F.struct(-F.unix_timestamp("updated_at"), priority(), F.col("pos")) if f in BY_RECENCY else F.struct(priority(), F.col("pos"))
        filled = F.coalesce(F.col(f).cast("string"), F.lit("")) != ""
        out.append(F.min_by(F.when(filled, F.col(f)), F.when(filled, order)).alias(f))
    return records.groupBy("customer_id").agg(*out)


def nested(records: DataFrame, column: str, keys: Sequence[str] = (), lower: bool = False, non_empty: bool = False) -> DataFrame:
    """``(customer_id, items)``: the items of all records with their source, the first of each key staying; no keys, no dedupe."""
    e = records.select("customer_id", "pos", "source_system", F.posexplode(column).alias("i", "item"))
    item = F.struct("item.*", F.col("source_system").alias("source"))
    if keys:
        k = F.concat_ws("-", *[F.lower(f"item.{x}") if lower else F.col(f"item.{x}").cast("string") for x in keys])
        e = e.withColumn("k", k)
        e = e.where("k <> ''") if non_empty else e
        e = e.groupBy("customer_id", "k").agg(F.min_by(F.struct(F.struct("pos", "i").alias("o"), item.alias("item")), F.struct("pos", "i")).alias("x")).select("customer_id", "x.o", "x.item")
    else:
        e = e.select("customer_id", F.struct("pos", "i").alias("o"), item.alias("item"))
    return e.groupBy("customer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "item"))), lambda x: x["item"]).alias("items"))


def financial_summary(accounts: DataFrame) -> DataFrame:
    a = accounts.select("customer_id", F.explode("items").alias("a"))
    return a.groupBy("customer_id").agg(F.count("*").alias("account_count"), F.sum(F.coalesce("a.balance", F.lit(0.0))).alias("total_balance"), F.sum(F.coalesce("a.credit_limit", F.lit(0.0))).alias("total_credit_limit"), F.array_sort(F.collect_set("a.account_type")).alias("account_types"), F.array_sort(F.collect_set("a.currency")).alias("currencies"))


def attribute_keys(records: DataFrame, column: str = "attributes") -> DataFrame:
    """``(customer_id, keys)``: every attribute that any record has."""
    k = records.select("customer_id", F.explode(F.map_keys(column)).alias("k"))
    return k.groupBy("customer_id").agg(F.array_sort(F.collect_set("k")).alias("keys"))


def golden_attributes(records: DataFrame, column: str = "attributes", confidence: str = "confidences") -> DataFrame:
    """``(customer_id, attributes)`` over maps: identity by source priority, contact by date, others by confidence (1 unless given), then priority."""
    e = records.select("customer_id", "pos", "source_system", "updated_at", F.col(confidence).alias("conf"), F.explode(column).alias("k", "v")).where("v is not null")
    recent = F.when(F.col("k").isin(*BY_RECENCY), -F.coalesce(F.unix_timestamp("updated_at"), F.lit(-1 << 62))).otherwise(0)
    sure = F.when(F.col("k").isin(*BY_RECENCY, *BY_PRIORITY), 0.0).otherwise(-F.coalesce(F.element_at("conf", F.col("k")), F.lit(1.0)))
    best = e.groupBy("customer_id", "k").agg(F.min_by("v", F.struct(recent, sure, priority(), F.col("pos"))).alias("v"))
    return best.groupBy("customer_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))


def first_flagged(records: DataFrame, flag: str, fields: Sequence[str]) -> DataFrame:
    """``(customer_id, flag, fields ...)`` of the first record that carries the flag; false and nulls where none does."""
    on = F.coalesce(F.col(flag), F.lit(False))
    g = records.groupBy("customer_id").agg(F.min_by(F.when(on, F.struct(*fields)), F.when(on, F.col("pos"))).alias("f"))
    return g.select("customer_id", F.col("f").isNotNull().alias(flag), *[F.col(f"f.{c}").alias(c) for c in fields])


def build_view(records: DataFrame, fields: Sequence[str], as_of: datetime) -> DataFrame:
    """One nested row for each customer: golden record, contact, risk, compliance, quality and sources, joined by customer once each."""
    gold = golden(records, fields)
    lists = [nested(records, c, keys, lower, True).withColumnRenamed("items", c) for c, keys, lower in (("phones", ("number",), False), ("emails", ("address",), True)) if c in records.columns]
    risk, kyc = risk_profile(records), kyc_status(records)
    quality = data_quality(records, gold, as_of)
    sources = records.groupBy("customer_id").agg(F.array_sort(F.collect_set("source_system")).alias("source_systems"), F.max("updated_at").alias("last_updated"))
    out = sources.join(gold.select("customer_id", F.struct(*fields).alias("golden_record")), "customer_id")
    out = out.join(risk.select("customer_id", F.struct("max_risk", "avg_risk", "risk_level", "risk_factors").alias("risk_profile")), "customer_id")
    out = out.join(kyc.select("customer_id", F.struct(F.col("kyc_status").alias("kyc"), "is_sanctioned", "is_pep").alias("compliance")), "customer_id")
    out = out.join(quality.select("customer_id", F.struct("overall_score", "completeness", "accuracy").alias("data_quality")), "customer_id")
    for x in lists:
        out = out.join(x, "customer_id", "left")
    contact = [F.coalesce(c, F.array()).alias(c) for c in ("phones", "emails") if c in records.columns]
    return out.select("customer_id", "golden_record", F.struct(*contact).alias("contact"), "risk_profile", "compliance", "data_quality", "source_systems", "last_updated")


def risk_profile(records: DataFrame) -> DataFrame:
    """Greatest and mean non-zero risk score, its level, and all risk factors."""
    s = F.when(F.col("risk_score") != 0, F.col("risk_score"))
    none = F.array().cast("array<string>")
    factors = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("risk_factors", none))))) if "risk_factors" in records.columns else F.first(none)
    g = records.groupBy("customer_id").agg(F.coalesce(F.max(s), F.lit(0.0)).alias("max_risk"), F.coalesce(F.avg(s), F.lit(0.0)).alias("avg_risk"), factors.alias("risk_factors"))
    return g.withColumn("risk_level", risk_level(F.col("max_risk")))


def kyc_status(records: DataFrame) -> DataFrame:
    """The latest KYC struct, and whether any record is sanctioned or a PEP."""
    has = F.col("kyc_status").isNotNull()
    return records.groupBy("customer_id").agg(F.max_by(F.when(has, F.col("kyc_status")), F.when(has, F.struct("kyc_status.verification_date", -F.col("pos")))).alias("kyc_status"), F.bool_or(F.coalesce("is_sanctioned", F.lit(False))).alias("is_sanctioned"), F.bool_or(F.coalesce("is_pep", F.lit(False))).alias("is_pep"))


def data_quality(records: DataFrame, gold: DataFrame, as_of: datetime) -> DataFrame:
    """Six dimensions and their weighted sum for each customer."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    present = sum((F.when(filled(c), w).otherwise(0.0) for c, w in REQUIRED.items() if c in gold.columns), F.lit(0.0))
    mail, dob = filled("email"), filled("date_of_birth")
    ok = F.when(mail & F.col("email").contains("@"), 1).otherwise(0) + F.when(dob & F.expr("try_to_timestamp(date_of_birth)").isNotNull(), 1).otherwise(0)
    checks = F.when(mail, 1).otherwise(0) + F.when(dob, 1).otherwise(0)
    g = gold.select("customer_id", (present / sum(REQUIRED.values())).alias("completeness"), F.coalesce(ratio(ok, checks), F.lit(1.0)).alias("accuracy"))
    aggs = [F.count("*").alias("n"), F.avg(F.datediff(F.lit(as_of), F.col("updated_at"))).alias("age")]
    fields = ("name", "date_of_birth", "nationality")
    for f in fields:
        v = F.nullif(F.col(f), F.lit(""))
        aggs += [F.count(v).alias(f"n_{f}"), F.countDistinct(v).alias(f"d_{f}")]
    r = records.groupBy("customer_id").agg(*aggs)
    comparable = sum((F.when(F.col(f"n_{f}") >= 2, 1).otherwise(0) for f in fields), F.lit(0))
    equal = sum((F.when((F.col(f"n_{f}") >= 2) & (F.col(f"d_{f}") == 1), 1).otherwise(0) for f in fields), F.lit(0))
    r = r.select("customer_id", F.coalesce(ratio(equal, comparable), F.lit(1.0)).alias("consistency"), F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("age") / 365), F.lit(0.5)).alias("timeliness"), F.when(F.col("n") > 1, 0.8).otherwise(1.0).alias("uniqueness"), F.lit(1.0).alias("validity"))
    total = sum((F.col(k) * w for k, w in QUALITY.items()), F.lit(0.0))
    return g.join(r, "customer_id").withColumn("overall_score", total)


def timeline(events: DataFrame) -> DataFrame:
    """A customer's events newest first."""
    return events.groupBy("customer_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("at", "kind", "detail")))).alias("timeline"))
