"""Card checks on a stream in order of event time, with a state variable for each thing that is remembered.

Rows wait in the state until the watermark has passed them, so they are judged in order of time and id
however they arrive, and the stream says what ``fraud.card_fraud`` says of the whole table. Rows behind the watermark
are dropped by Spark and counted in the query's metrics. Needs the RocksDB state store (``ROCKSDB``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.fraud import VELOCITY

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DAY = 86_400
DECLINES = 10


class CardHistory(StatefulProcessor):
    """One card: rows that wait (map by time and id), the last outcomes and times (lists), the greatest amount and last places (a value).

    Each variable is written only where it changes. ``recent`` goes a day after the last payment, as it can then
    matter no more; all but it stays for ``keep`` seconds after, or for good where that is None.
    """

    def __init__(self, id_type: str, keep: int | None):
        self.keep = keep
        columns = {
            "place": f"micros bigint, id {id_type}", "row": "amount double, country string, declined boolean", "second": "second bigint", "outcome": "declined boolean",
            "known": "most double, country string, at bigint, other string, other_at bigint, seen bigint",
        }
        self.schemas = {k: StructType.fromDDL(v) for k, v in columns.items()}  # on the driver

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, s = handle, self.schemas
        self.waiting = handle.getMapState("waiting", s["place"], s["row"])
        self.recent = handle.getListState("recent", s["second"])
        self.outcomes = handle.getListState("outcomes", s["outcome"])
        self.known = handle.getValueState("known", s["known"])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in rows:
            self.waiting.updateValue((r["micros"], r["transaction_id"]), (r["amount"], r["merchant_country"], r["status"] == "declined"))
            self.handle.registerTimer(r["micros"] // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(((k[0], k[1]), tuple(v)) for k, v in self.waiting.iterator() if k[0] // 1000 < now) if self.waiting.exists() else []
        if not due:
            self.forget(now)
            return
        most, country, at, other, other_at, seen = self.known.get() if self.known.exists() else (None,) * 6
        recent = [x[0] for x in self.recent.get()] if self.recent.exists() else []
        declined = [x[0] for x in self.outcomes.get()] if self.outcomes.exists() else []
        for (micros, i), (amount, place, was_declined) in due:
            t, found = micros // 1_000_000, []
            if (most is not None and amount is not None and amount < 5 and most > amount) or sum(declined) >= 3:
                found.append("card_testing_pattern")
            if sum(x >= t - DAY for x in recent) > VELOCITY:
                found.append("high_velocity")
            if place is not None:
                if country is not None and country != place:
                    other, other_at = country, at
                if other is not None and t - other_at < 3 * 3600:
                    found.append("geographic_anomaly")
                country, at = place, t
            if found:
                yield Row(cardholder_id=key[0], transaction_id=i, indicators=found)
            recent, declined, seen = [*recent, t][-VELOCITY - 1 :], [*declined, was_declined][-DECLINES:], t
            most = amount if most is None or amount is not None and amount > most else most
            self.waiting.removeKey((micros, i))
        self.recent.put([(x,) for x in recent])
        self.outcomes.put([(x,) for x in declined])
        self.known.update((most, country, at, other, other_at, seen))
        self.handle.registerTimer((seen + DAY + 1) * 1000)
        if self.keep is not None:
            self.handle.registerTimer((seen + self.keep + 1) * 1000)

    def forget(self, now: int) -> None:
        """Clear what is too old to matter, if nothing has come since."""
        seen = self.known.get()[5] if self.known.exists() else None
        if seen is None:
            return
        if now > (seen + DAY) * 1000 and self.recent.exists():
            self.recent.clear()
        if self.keep is not None and now > (seen + self.keep) * 1000:
            self.known.clear()
            self.outcomes.clear()

    def close(self) -> None:
        pass


def ordered_card_alerts(tx: DataFrame, delay: str = "24 hours", keep: int | None = None) -> DataFrame:
    """``(cardholder_id, transaction_id, indicators)`` of the checks of ``fraud.card_fraud`` that need history, ``delay`` behind the newest row."""
    kinds = {f.name: f.dataType.simpleString() for f in tx.schema.fields}
    rows = tx.withWatermark("timestamp", delay).select("cardholder_id", "transaction_id", F.col("amount").cast("double").alias("amount"), "merchant_country", "status", "timestamp", F.unix_micros("timestamp").alias("micros"))
    schema = StructType.fromDDL(f"cardholder_id {kinds['cardholder_id']}, transaction_id {kinds['transaction_id']}, indicators array<string>")
    return rows.groupBy("cardholder_id").transformWithState(CardHistory(kinds["transaction_id"], keep), schema, "append", "eventTime")
