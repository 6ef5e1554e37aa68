"""The rules on streams: column rules unchanged, windows with watermarks, per-key state for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import fraud, monitoring

STATELESS = {k: monitoring.RULES[k] for k in ("round_amounts", "jurisdictions", "timing")}


def files(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def kafka(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """JSON payloads of a topic; needs the Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


def kafka_records(rows: DataFrame, key: str) -> DataFrame:
    """``(key, value)`` with each row as JSON, nulls included: what a Kafka sink writes."""
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"}
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*"), options).alias("value"))


def to_kafka(alerts: DataFrame, servers: str, topic: str, key: str, checkpoint: str):
    """A started query that writes ``alerts`` to a topic; needs the Kafka package on the class path."""
    return kafka_records(alerts, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).outputMode("append").start()


def stateless_alerts(tx: DataFrame, rules: tuple[str, ...] = tuple(STATELESS)) -> DataFrame:
    out = None
    for r in rules:
        a = STATELESS[r](tx).withColumn("alert_id", F.md5(F.concat_ws("_", F.lit(r), F.col("id").cast("string"))))
        a = a.select("alert_id", "alert_type", "severity", "risk_score", "id", "sender_entity_id", "transaction_date")
        out = a if out is None else out.unionByName(a)
    return out


def deduplicated(alerts: DataFrame, delay: str = "24 hours") -> DataFrame:
    return alerts.withWatermark("transaction_date", delay).dropDuplicatesWithinWatermark(["alert_id"])


def windowed_structuring(tx: DataFrame, threshold: float = 9500, hours: int = 24, min_transactions: int = 3, slide_hours: int | None = None) -> DataFrame:
    """Banded amounts by sender and tumbling (or sliding) window; late rows beyond the watermark are dropped."""
    w = F.window("transaction_date", f"{hours} hours", f"{slide_hours or hours} hours")
    band = tx.where((F.col("amount") >= threshold) & (F.col("amount") < 10000)).withWatermark("transaction_date", f"{hours} hours")
    g = band.groupBy("sender_entity_id", w.alias("w")).agg(F.sum("amount").alias("total_amount"), F.count("*").alias("transaction_count"))
    return g.where((F.col("transaction_count") >= min_transactions) & (F.col("total_amount") >= 10000)).select("sender_entity_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total_amount", "transaction_count")


def sessions(tx: DataFrame, gap: str = "30 minutes", delay: str = "24 hours") -> DataFrame:
    g = tx.withWatermark("transaction_date", delay).groupBy("sender_entity_id", F.session_window("transaction_date", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return g.select("sender_entity_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


KEEP = 30 * 24 * 3600
STATE = "seconds array<long>, declined array<boolean>, most double, country string, at long, other string, other_at long"


def card_alerts(tx: DataFrame, delay: str = "24 hours", keep: int = KEEP) -> DataFrame:
    """Card payments that look like testing, come too often, or from two countries within three hours.

    The checks are those of ``fraud.card_fraud`` that need history. State is one row a card:
    times of a day, the last ten outcomes, the greatest amount, the last country, and the
    last other one; it goes when the watermark is ``keep`` seconds past the last payment.
    Payments of a batch are taken in order of time and id; late ones are seen when they come.
    """
    kinds = {f.name: f.dataType.simpleString() for f in tx.schema.fields}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seconds, declined, most, country, at, other, other_at = state.get if state.exists else ([], [], None, None, None, None, None)
        seconds, declined, out = list(seconds), list(declined), []
        rows = pd.concat(list(batches)).sort_values(["timestamp", "transaction_id"])
        times = (rows["timestamp"].astype("datetime64[us]").astype("int64") // 1_000_000).tolist()
        for t, i, amount, place, status in zip(times, rows["transaction_id"].tolist(), rows["amount"].tolist(), rows["merchant_country"].tolist(), rows["status"].tolist(), strict=True):
            found = []
            if (most is not None and amount < 5 and most > amount) or sum(declined) >= 3:
                found.append("card_testing_pattern")
            seconds = [x for x in seconds if x >= t - 86400]
            if len(seconds) > 10:
                found.append("high_velocity")
            if place is not None:
                if country is not None and country != place:
                    other, other_at = country, at
                if other is not None and other != place and t - other_at < 3 * 3600:
                    found.append("geographic_anomaly")
                country, at = place, t
            if found:
                out.append((k[0], i, found))
            seconds.append(t)
            declined = [*declined, status == "declined"][-10:]
            most = amount if most is None else max(most, amount)
        state.update((seconds, declined, most, country, at, other, other_at))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), times[-1] * 1000) + keep * 1000)
        yield pd.DataFrame(out, columns=["cardholder_id", "transaction_id", "indicators"])

    marked = tx.withWatermark("timestamp", delay).select("cardholder_id", "transaction_id", "amount", "merchant_country", "status", "timestamp")
    schema = f"cardholder_id {kinds['cardholder_id']}, transaction_id {kinds['transaction_id']}, indicators array<string>"
    return marked.groupBy("cardholder_id").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def wallet_alerts(tx: DataFrame) -> DataFrame:
    """Wallet payments to or from a mixer or a sanctioned address, and dust; no state."""
    c = F.col
    checks = {
        "mixer_usage": fraud.contains_any(c("to_address"), fraud.MIXERS), "mixer_source": fraud.contains_any(c("from_address"), fraud.MIXERS),
        "sanctioned_address": fraud.starts_any(c("to_address"), fraud.SANCTIONED) | fraud.starts_any(c("from_address"), fraud.SANCTIONED), "potential_dust_attack": F.coalesce(fraud.dust(c("amount"), c("currency")), F.lit(False)),
    }
    names = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in checks.items()]))
    return tx.withColumn("indicators", names).where(F.size("indicators") > 0)


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop, for schedulers."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
