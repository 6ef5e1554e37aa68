"""Sinks that a repeated batch does not change, and a schedule of named jobs with a ledger of what has run."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, release

BATCH, BUCKET = "batch_id", "bucket"
BUCKETS = 64


def append_batch(rows: DataFrame, batch: int, path: str) -> None:
    """Write a batch as the partition of its number: the same batch again replaces itself and nothing else."""
    rows.withColumn(BATCH, F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def bucket_of(key: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def merge_batch(rows: DataFrame, path: str, key: str = "id", order: str | None = None, buckets: int = BUCKETS) -> list[int]:
    """Replace the rows of equal ``key`` in the table at ``path`` and add new ones; the buckets that were written.

    The table is kept in ``buckets`` folders by a hash of the key; only those that a row falls into are read and written
    again. Of rows that repeat a key the greatest by ``order`` stays (all columns after it break ties). A batch that
    comes twice leaves the same table. Rows without a key are refused.
    """
    spark = rows.sparkSession
    if not rows.where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"rows without {key}")
    place = F.struct(*([order] if order else []), *[c for c in rows.columns if c not in (key, order)])
    last = rows.groupBy(key).agg(F.max(place).alias("__r")).select(*[F.col(c) if c == key else F.col(f"__r.{c}").alias(c) for c in rows.columns])
    last = materialize(last.withColumn(BUCKET, bucket_of(key, buckets)), "batch")
    touched = sorted(r[0] for r in last.select(BUCKET).distinct().collect())  # at most ``buckets``
    if touched:
        try:
            old = spark.read.schema(last.schema).parquet(path).where(F.col(BUCKET).isin(*touched))
            merged = old.join(last.select(key), key, "left_anti").unionByName(last)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            merged = last
        done = materialize(merged, "merged")  # the table is read in full before any of it is replaced
        done.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
        release(done)
    release(last)
    return touched


def remove_keys(keys: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> list[int]:
    """Delete the rows of ``keys`` from a table of ``merge_batch``; the buckets that were written again. The same keys again delete nothing more."""
    spark = keys.sparkSession
    gone = materialize(keys.select(key).distinct().withColumn(BUCKET, bucket_of(key, buckets)), "gone")
    table = spark.read.parquet(path)
    hit = sorted(r[0] for r in table.select(key, BUCKET).join(gone.select(key), key, "left_semi").select(BUCKET).distinct().collect())
    if hit:
        rest = materialize(table.where(F.col(BUCKET).isin(*hit)).join(gone.select(key), key, "left_anti"), "rest")
        full = {r[0] for r in rest.select(BUCKET).distinct().collect()}
        rest.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
        for b in hit:
            if b not in full:  # dynamic overwrite leaves a partition that has no new rows
                drop_folder(spark, f"{path}/{BUCKET}={b}")
        release(rest)
    release(gone)
    return hit


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def to_sink(path: str, key: str | None = None, order: str | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merge by ``key``, or append under the number of the batch."""

    def write(rows: DataFrame, batch: int) -> None:
        if key is None:
            append_batch(rows, batch, path)
        else:
            merge_batch(rows, path, key, order)

    return write


# scheduled jobs ------------------------------------------------------------------


@dataclass(frozen=True)
class Scheduled:
    """A job ``run(spark, start, end)`` for each slot of ``every`` since ``since``; it must give the same output for the same slot."""

    name: str
    every: timedelta
    run: Callable[[SparkSession, datetime, datetime], None]
    since: datetime


# The jobs, how often they run, and how long after midnight (of a Sunday for weekly ones) the first slot starts.
SCHEDULE = {
    "entity_resolution_sync": (timedelta(hours=1), timedelta(0)), "network_analysis_refresh": (timedelta(hours=4), timedelta(0)), "risk_score_recalculation": (timedelta(hours=1), timedelta(minutes=30)),
    "watchlist_sync": (timedelta(days=1), timedelta(hours=2)), "cleanup_old_data": (timedelta(days=7), timedelta(hours=3)),
}


def scheduled(name: str, run: Callable[[SparkSession, datetime, datetime], None], since: datetime) -> Scheduled:
    """A job of SCHEDULE from the first of its times that is not before ``since``."""
    every, first = SCHEDULE[name]
    sunday = datetime(2023, 1, 1) + first
    return Scheduled(name, every, run, sunday + -(-(since - sunday) // every) * every)


def slots(job: Scheduled, now: datetime) -> list[tuple[datetime, datetime]]:
    """The slots that have ended by ``now``."""
    n = max(0, int((now - job.since) / job.every))
    return [(job.since + k * job.every, job.since + (k + 1) * job.every) for k in range(n)]


def finished(spark: SparkSession, ledger: str) -> DataFrame:
    """``(job, slot)`` of what has run, from the ledger folder."""
    schema = "job string, slot timestamp"
    try:
        return spark.read.schema(schema).parquet(ledger).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def run_due(spark: SparkSession, jobs: Iterable[Scheduled], ledger: str, now: datetime, most: Mapping[str, int] | None = None) -> list[tuple[str, datetime]]:
    """Run every slot that has ended and is not in the ledger, oldest first (of a job at most ``most`` slots); what has run.

    A slot is entered after its job has ended, so a job that fails, or whose entry is lost, runs again for the same slot.
    """
    done = {(r["job"], r["slot"]) for r in finished(spark, ledger).collect()}  # a row a slot
    ran = []
    for job in jobs:
        due = [s for s in slots(job, now) if (job.name, s[0]) not in done]
        for start, end in due[: (most or {}).get(job.name)]:
            job.run(spark, start, end)
            spark.createDataFrame([(job.name, start)], "job string, slot timestamp").coalesce(1).write.mode("append").parquet(ledger)
            ran.append((job.name, start))
    return ran
