"""Transaction-monitoring rules, entity risk and the pipeline over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import epoch_hours, ladder, ratio
from ..functions.segments import HALO, HOT_ROWS, PART, segmented, with_halo

# Countries of high risk.
HIGH_RISK = ("KP", "IR", "MM", "SY", "YE", "AF")


def structuring(tx: DataFrame, threshold: float = 9500, window_hours: int = 24, min_transactions: int = 3, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Amounts just under 10000, close in time, per sender and tumbling window; a sender's first such payment has no gap and is left out."""
    band = segmented(tx.where((F.col("amount") >= threshold) & (F.col("amount") < 10000)), ["sender_entity_id"], ["transaction_date", "id"], hot_rows)
    gap = epoch_hours(F.col("transaction_date"), F.lag("transaction_date").over(band.window()))
    close = with_halo(band, 1).withColumn("gap", gap).where(~F.col(HALO) & (F.col("gap") <= window_hours))
    g = close.groupBy("sender_entity_id", F.window("transaction_date", f"{window_hours} hours").alias("w")).agg(F.sum("amount").alias("total_amount"), F.count("*").alias("transaction_count"), F.array_sort(F.collect_list("id")).alias("transaction_ids"))
    kept = g.where((F.col("transaction_count") >= min_transactions) & (F.col("total_amount") >= 10000))
    score = ladder(F.col("total_amount"), [(50000, 0.9), (25000, 0.7)], 0.5)
    return kept.select("sender_entity_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total_amount", "transaction_count", "transaction_ids", F.lit("structuring").alias("alert_type"), F.lit("high").alias("severity"), score.alias("risk_score"))


def velocity(tx: DataFrame, lookback: int = 30, threshold: float = 3, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Days whose number of payments is far above that of the sender's preceding ``lookback`` payments."""
    days = tx.withColumn("__day", F.date_trunc("day", "transaction_date"))
    counts = days.groupBy(F.col("sender_entity_id").alias("__sender"), F.col("__day").alias("__on")).agg(F.count("*").alias("daily_count"))
    days = days.join(counts, F.col("sender_entity_id").eqNullSafe(F.col("__sender")) & F.col("__day").eqNullSafe(F.col("__on")))
    late = F.col("transaction_date").isNull()  # payments without a time come last
    s = segmented(days.drop("__sender", "__on", "__day"), ["sender_entity_id"], [late, "transaction_date", "id"], hot_rows)
    w = s.window().rowsBetween(-lookback, -1)
    c = F.col("daily_count")
    d = with_halo(s, lookback).withColumns({"__n": F.count(c).over(w), "__sum": F.sum(c).over(w), "__squares": F.sum(c * c).over(w)}).where(~F.col(HALO)).drop(HALO, PART)
    # sums of counts are exact, so a score that is just the threshold reaches it in whatever order they are added
    n, total, squares = (F.col(x).cast("decimal(19,0)") for x in ("__n", "__sum", "__squares"))
    above = n * c - total
    spread = (n * squares - total * total).cast("decimal(38,0)")  # the variance times n (n - 1)
    d = d.withColumns({"avg_daily": ratio(F.col("__sum"), F.col("__n")), "std_daily": F.sqrt(ratio(spread.cast("double"), F.col("__n") * (F.col("__n") - 1)))})
    d = d.withColumns({"__up": (above * F.abs(above) * (n - 1)).cast("decimal(38,0)"), "__down": (n * spread).cast("decimal(38,0)")}).where("__down > 0")

    def reaches(z: float) -> Column:
        t = Fraction(str(z))
        return F.col("__up") * t.denominator**2 >= F.col("__down") * (t.numerator * abs(t.numerator))

    square = F.col("__up").cast("double") / F.col("__down").cast("double")
    d = d.where(reaches(threshold)).withColumn("z_score", F.signum(square) * F.sqrt(F.abs(square)))
    severity = F.when(reaches(5), "critical").when(reaches(4), "high").otherwise("medium")
    d = d.withColumn("severity", severity).drop("__n", "__sum", "__squares", "__up", "__down")
    return d.withColumnRenamed("risk_score", "tx_risk_score").withColumns({"alert_type": F.lit("velocity_spike"), "risk_score": F.round(F.col("z_score") / 10, 2)})


def round_amounts(tx: DataFrame) -> DataFrame:
    a = F.col("amount")
    thousand, half = (a % 1000 == 0) & (a >= 1000), (a % 500 == 0) & (a >= 500)
    score = F.when(thousand & (a >= 10000), 0.6).when(thousand, 0.4).otherwise(0.2)
    return tx.where(thousand | half).withColumnRenamed("risk_score", "tx_risk_score").withColumns({"alert_type": F.lit("round_amount"), "severity": F.lit("low"), "risk_score": score})


def jurisdictions(tx: DataFrame, countries: Sequence[str] = HIGH_RISK) -> DataFrame:
    hit = F.col("sender_country").isin(*countries) | F.col("receiver_country").isin(*countries)
    return tx.where(hit).withColumnRenamed("risk_score", "tx_risk_score").withColumns({"alert_type": F.lit("high_risk_jurisdiction"), "severity": F.lit("high"), "risk_score": F.lit(0.8)})


def timing(tx: DataFrame) -> DataFrame:
    """Before 6, after 22 o'clock, or at the weekend."""
    hour, day = F.hour("transaction_date"), F.dayofweek("transaction_date")
    off, weekend = (hour < 6) | (hour > 22), day.isin(1, 7)
    score = F.when(off & weekend, 0.4).when(off, 0.3).otherwise(0.2)
    return tx.where(off | weekend).withColumnRenamed("risk_score", "tx_risk_score").withColumns({"alert_type": F.lit("unusual_timing"), "severity": F.lit("low"), "risk_score": score})


def entity_risk(tx: DataFrame) -> DataFrame:
    """One row for each sender: volumes and a risk score of four ladders."""
    c = F.col
    g = tx.groupBy(c("sender_entity_id").alias("entity_id")).agg(
        F.count("*").alias("transaction_count"), F.sum("amount").alias("total_volume"), F.avg("amount").alias("avg_amount"), F.stddev("amount").alias("std_amount"),
        F.sum(F.when(c("is_flagged") == 1, 1).otherwise(0)).alias("flagged_count"), F.count(F.when(c("sender_country") != c("receiver_country"), 1)).alias("cross_border_count"),
    )
    volume = ladder(c("total_volume"), [(1_000_000, 0.3), (100_000, 0.2)], 0.1)
    activity = ladder(c("transaction_count"), [(100, 0.2), (50, 0.1)], 0.05)
    flags = ladder(c("flagged_count"), [(10, 0.4), (5, 0.3), (1, 0.2)], 0.0)
    cross = ratio(c("cross_border_count"), c("transaction_count")) * 0.2
    return g.withColumns({"volume_risk": volume, "activity_risk": activity, "flag_risk": flags, "cross_border_risk": cross}).withColumn("risk_score", F.round(F.expr("volume_risk + activity_risk + flag_risk + cross_border_risk"), 3))


RULES: dict[str, Callable[[DataFrame], DataFrame]] = {"structuring": structuring, "velocity": velocity, "round_amounts": round_amounts, "jurisdictions": jurisdictions, "timing": timing}
ALERT = ("alert_type", "severity", "risk_score", "entity_id", "amount", "transaction_ids")


def canonical(alerts: DataFrame) -> DataFrame:
    """One schema for the alerts of all rules."""
    many = "transaction_ids" in alerts.columns
    return alerts.select("alert_type", "severity", F.col("risk_score").cast("double"), F.col("sender_entity_id").cast("string").alias("entity_id"), F.col("total_amount" if many else "amount").alias("amount"), (F.col("transaction_ids") if many else F.array("id")).cast("array<string>").alias("transaction_ids"))


def all_alerts(tx: DataFrame, rules: Sequence[str] = tuple(RULES)) -> DataFrame:
    out = None
    for name in rules:
        part = canonical(RULES[name](tx))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no rules are named")
    return out


def run_pipeline(tx: DataFrame, output: str, rules: Sequence[str] = tuple(RULES)) -> DataFrame:
    """Write ``/entity_risks`` and ``/alerts`` (by alert type), each planned once, and return a row of totals."""
    spark = tx.sparkSession
    entity_risk(tx).write.mode("overwrite").parquet(f"{output}/entity_risks")
    all_alerts(tx, rules).write.mode("overwrite").partitionBy("alert_type").parquet(f"{output}/alerts")
    risks = spark.read.parquet(f"{output}/entity_risks").agg(F.count("*").alias("entities"), F.count_if(F.col("risk_score") >= 0.5).alias("high_risk_entities"))
    return risks.crossJoin(spark.read.parquet(f"{output}/alerts").agg(F.count("*").alias("alerts")))  # one row each
