"""Sources, sinks, schedules and the card checks on a stream in order."""

import glob
import http.server
import json
import os
import random
import threading
import urllib.parse
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sentrail.operators import fraud, resolution, screening
from sentrail.sources import rest, tables
from sentrail.streaming import cards, rules, sinks

START = datetime(2024, 1, 1)

# sinks ---------------------------------------------------------------------------


def state(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


def content(spark, path):
    return {r["id"]: (r["v"], r["at"]) for r in spark.read.parquet(path).collect()}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(i, f"a{i}", 1) for i in range(200)], "id long, v string, at long")
    assert len(sinks.merge_batch(first, path, order="at", buckets=16)) == 16
    before, was = state(path), content(spark, path)
    second = spark.createDataFrame([(3, "new", 2), (3, "old", 1), (500, "x", 2)], "id long, v string, at long")
    touched = sinks.merge_batch(second, path, order="at", buckets=16)
    want = was | {3: ("new", 2), 500: ("x", 2)}
    assert content(spark, path) == want and 1 <= len(touched) <= 2
    after = state(path)
    assert {f for f in before if f in after} == {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert all(after[f] == before[f] for f in before if f in after)
    sinks.merge_batch(second, path, order="at", buckets=16)
    assert content(spark, path) == want
    with pytest.raises(ValueError, match="without id"):
        sinks.merge_batch(spark.createDataFrame([(None, "x", 1)], "id long, v string, at long"), path, buckets=16)


def test_removed_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.merge_batch(spark.createDataFrame([(i, "a", 1) for i in range(40)], "id long, v string, at long"), path, buckets=64)
    gone = spark.createDataFrame([(1,), (2,), (99,)], "id long")
    hit = sinks.remove_keys(gone, path, buckets=64)
    assert set(content(spark, path)) == set(range(40)) - {1, 2} and 1 <= len(hit) <= 2
    assert sinks.remove_keys(gone, path, buckets=64) == []


def test_a_stream_into_a_table_after_a_failure(spark, tmp_path):
    """A batch that fails after it has written is written again, with the same result."""
    source, path, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    failed = []

    def once(rows, batch):
        sinks.to_sink(path, "id", "at")(rows, batch)
        sinks.to_sink(f"{path}-log")(rows, batch)
        if not failed:
            failed.append(batch)
            raise RuntimeError("after writing")

    def run():
        stream = spark.readStream.schema("id long, v string, at long").parquet(source)
        stream.writeStream.foreachBatch(once).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, at long").write.parquet(source)
    with pytest.raises(Exception, match="after writing"):
        run()
    run()
    spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "id long, v string, at long").write.mode("append").parquet(source)
    run()
    assert content(spark, path) == {1: ("a", 1), 2: ("c", 2), 3: ("d", 2)}
    assert spark.read.parquet(f"{path}-log").count() == 4


def test_schedule(spark, tmp_path):
    ran, ledger = [], str(tmp_path / "ledger")

    def job(name, fail_at=None):
        def run(_, start, end):
            if start == fail_at and ("failed", start) not in ran:
                ran.append(("failed", start))
                raise RuntimeError(name)
            ran.append((name, start))

        return run

    hour = sinks.scheduled("risk_score_recalculation", job("score", datetime(2024, 1, 1, 2, 30)), datetime(2024, 1, 1, 1))
    day = sinks.scheduled("watchlist_sync", job("list"), datetime(2024, 1, 1, 1))
    week = sinks.scheduled("cleanup_old_data", job("clean"), datetime(2024, 1, 1))
    assert (hour.since, day.since, week.since) == (datetime(2024, 1, 1, 1, 30), datetime(2024, 1, 1, 2), datetime(2024, 1, 7, 3))
    now = datetime(2024, 1, 1, 4)
    with pytest.raises(RuntimeError):
        sinks.run_due(spark, [hour, day, week], ledger, now)
    assert sinks.run_due(spark, [hour, day, week], ledger, now) == [("risk_score_recalculation", datetime(2024, 1, 1, 2, 30))]
    assert sinks.run_due(spark, [hour, day, week], ledger, now) == []
    assert [x for x in ran if x[0] == "score"] == [("score", datetime(2024, 1, 1, 1, 30)), ("score", datetime(2024, 1, 1, 2, 30))]
    assert sinks.run_due(spark, [day], ledger, datetime(2024, 1, 4, 2), {"watchlist_sync": 2}) == [("watchlist_sync", datetime(2024, 1, d, 2)) for d in (1, 2)]


# cards on a stream -------------------------------------------------------------------


def test_cards_in_order_equal_the_batch(spark, tmp_path):
    """Rows come out of order over three files; the stream is stopped and started between them."""
    rng = random.Random(9)
    rows = []
    for i in range(240):
        t = START + timedelta(seconds=rng.choice([rng.randrange(200), rng.randrange(30_000), rng.randrange(200_000)]))
        rows.append((rng.choice([1, 1, 2, 3]), i, rng.choice([1.0, 2.0, 50.0]), rng.choice(["US", "GB", None]), rng.choice(["declined", "approved"]), t))
    schema = "cardholder_id long, transaction_id long, amount double, merchant_country string, status string, timestamp timestamp"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k, v in cards.ROCKSDB.items():
        spark.conf.set(k, v)

    def run(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        alerts = cards.ordered_card_alerts(stream, "4 days")
        alerts.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    try:
        for k in range(3):
            run(rows[k::3])
        run([(9, 9999, 1.0, None, "approved", START + timedelta(days=30))])  # the watermark passes all the others
        run([(9, 10000, 1.0, None, "approved", START + timedelta(days=30))])
        late = (1, 777, 1.0, "US", "approved", START)
        run([late])
    finally:
        spark.conf.unset(next(iter(cards.ROCKSDB)))
    names = {"card_testing_pattern", "high_velocity", "geographic_anomaly"}
    flags = {c: F.lit(True) for c in ("is_card_present", "cvv_match", "avs_match", "three_ds")}
    batch = fraud.card_fraud(spark.createDataFrame(rows, schema).withColumns({"mcc": F.lit("1"), **flags})).collect()
    want = {r["transaction_id"]: set(r["indicators"]) & names for r in batch if set(r["indicators"]) & names}
    got = spark.read.parquet(out).collect()
    assert {r["transaction_id"]: set(r["indicators"]) for r in got} == want and len(got) == len(want) and want


# sources ---------------------------------------------------------------------------

ROWS = [{"id": i, "name": f"n{i}", "amount": i / 2, "flagged": i % 2 == 0, "transaction_date": (START + timedelta(days=i)).isoformat()} for i in range(53)]
SCHEMA = "id long, name string, amount double, flagged boolean, transaction_date timestamp"


@pytest.fixture
def endpoint():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            asked.append(q)
            rows = ROWS
            for k, v in q.items():
                name, _, how = k.partition("__")
                if name in ROWS[0]:
                    value = v if isinstance(ROWS[0][name], str) else json.loads(v)
                    rows = [r for r in rows if {"": r[name] == value, "gt": r[name] > value, "gte": r[name] >= value, "lt": r[name] < value, "lte": r[name] <= value}[how]]
            size, page = int(q["size"]), int(q["page"])
            body = json.dumps({"total": len(rows), "items": rows[(page - 1) * size : page * size]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/tx", asked
    server.shutdown()


def test_pages_are_read_in_parallel(spark, endpoint):
    url, asked = endpoint
    df = rest.paged(spark, url, SCHEMA, size=10, parts=3)
    assert df.rdd.getNumPartitions() == 3
    got = sorted(df.collect())
    assert [tuple(r) for r in got] == [(r["id"], r["name"], r["amount"], r["flagged"], datetime.fromisoformat(r["transaction_date"])) for r in ROWS]
    assert {int(q["page"]) for q in asked} == set(range(1, 7))


def test_filters_travel_with_the_request(spark, endpoint):
    url, asked = endpoint
    df = rest.paged(spark, url, SCHEMA, size=10).where("amount >= 20 and name = 'n44' and length(name) = 3")
    assert [r["id"] for r in df.collect()] == [44]
    assert any(q.get("amount__gte") == "20.0" and q.get("name") == "n44" for q in asked)


def test_lookback_and_limit(spark, endpoint):
    url, asked = endpoint
    df = rest.paged(spark, url, SCHEMA, size=4, limit=10, lookback_days=30, now=START + timedelta(days=50))
    assert sorted(r["id"] for r in df.collect()) == list(range(20, 30))
    assert all(q["transaction_date__gte"] == (START + timedelta(days=20)).isoformat() for q in asked)
    assert rest.paged(spark, url, SCHEMA, lookback_days=1, now=START + timedelta(days=500)).count() == 0


def test_a_provider_behind_an_endpoint(spark):
    """Entries of a list, however many, join names by a piece of one of their parts; the fixed patterns as entries give what they give as patterns."""
    entries = []
    for provider, parts, kind, confidence, score in screening.PATTERNS:
        for alternative in screening.alternatives(parts):
            entries.append((provider, list(alternative), kind, confidence, score))
    listed = spark.createDataFrame(entries, "provider string, parts array<string>, list_type string, confidence string, score double")
    names = ["Kim Il Jong", "Jong-kim", "Vladimir PUTIN, president", "Senator fraud scandal", "sec violation", "nobody", "", None, "mi", "ministerpresident"]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    want = {r["id"]: {tuple(m) for m in r["matches"]} for r in screening.matches(rows).collect()}
    got = {r["id"]: {tuple(m) for m in r["matches"]} for r in screening.matches_in(rows, listed).collect()}
    assert got == want


def test_repeated_names_and_entries_meet_once(spark):
    """A name that many rows have meets a set of parts that many entries have once, however many there are of either."""
    listed = spark.range(3000).select(F.lit("p").alias("provider"), F.array(F.lit("Red"), F.concat(F.lit("rin"), F.substring(F.lit("ggg"), 1, (F.col("id") % 2 + 1).cast("int")))).alias("parts"), F.lit("pep").alias("list_type"), F.lit("strong").alias("confidence"), (F.col("id") % 4).cast("double").alias("score"))
    rows = spark.range(3000).select("id", F.concat(F.lit("red RINGG"), (F.col("id") % 3).cast("string")).alias("name"))
    out = screening.matches_in(rows, listed)
    got = out.collect()
    assert len(got) == 3000 and all([m["score"] for m in r["matches"]] == [3.0, 2.0, 1.0, 0.0] for r in got)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [__low" in plan and "Aggregate [parts" in plan  # both sides are made distinct


class Recorder:
    """Stands in for a reader whose server is not there: what it was asked for."""

    def __init__(self):
        self.asked = {}

    def format(self, name):
        self.asked["format"] = name
        return self

    def option(self, k, v):
        self.asked[k] = v
        return self

    def options(self, **kv):
        self.asked |= kv
        return self

    def load(self):
        return self.frame


def test_jdbc_reads_in_key_ranges(spark):
    class Session:
        read = Recorder()

    Session.read.frame = None
    tables.jdbc(Session, "jdbc:postgresql://db/x", "transactions", "id", 1, 1_000_000, 48)
    assert Session.read.asked == {"format": "jdbc", "url": "jdbc:postgresql://db/x", "dbtable": "transactions", "partitionColumn": "id", "lowerBound": 1, "upperBound": 1_000_000, "numPartitions": 48}


def test_kafka_payloads(spark):
    class Session:
        readStream = Recorder()  # noqa: N815

    payloads = [('{"id": 1, "amount": 2.5}',), ("not json",), (None,)]
    Session.readStream.frame = spark.createDataFrame(payloads, "value string").withColumn("value", F.col("value").cast("binary"))
    got = rules.kafka(Session, "broker:9092", "tx", "id long, amount double")
    assert Session.readStream.asked == {"format": "kafka", "kafka.bootstrap.servers": "broker:9092", "subscribe": "tx"}
    assert [tuple(r) for r in got.collect()] == [(1, 2.5), (None, None), (None, None)]


def test_records_for_a_topic(spark):
    rows = spark.createDataFrame([(1, "a", START), (2, None, None)], "id long, v string, at timestamp")
    got = [(r["key"], json.loads(r["value"])) for r in rules.kafka_records(rows, "id").collect()]
    assert got == [("1", {"id": 1, "v": "a", "at": "2024-01-01T00:00:00.000Z"}), ("2", {"id": 2, "v": None, "at": None})]


def test_json_records_with_a_schema(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"id": "1", "name": "A", "x": 1}, {"id": "2"}]')
    assert [tuple(r) for r in tables.read_json_records(spark, str(tmp_path / "r.json"), "id string, name string").collect()] == [("1", "A"), ("2", None)]


def test_resolution_rate_and_dates(spark):
    five, three = spark.range(5), spark.range(3)
    assert tuple(resolution.resolution_rate(five, three).first()) == (5, 3, 0.4)
    assert tuple(resolution.resolution_rate(five.limit(0), three.limit(0)).first()) == (0, 0, 0.0)


def test_matches_of_some_list_types(spark):
    rows = spark.createDataFrame([(1, "Putin, minister of fraud")], "id long, name string")
    kinds = lambda *t: [m["list_type"] for m in screening.matches(rows, list_types=t or None).first()["matches"]]
    assert kinds() == ["pep", "sanctions", "adverse_media", "pep"] and kinds("adverse_media") == ["adverse_media"] and kinds("x") == []
