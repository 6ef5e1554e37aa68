"""Sessions and the shared folder in which long jobs cut their lineage."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "sentrail", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI mode and adaptive execution.

    ``conf`` keys use ``__`` for dots. On a cluster the master and the
    checkpoint folder come from spark-submit; nothing here overrides them.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


BATCH_ROWS = 2000


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows where the session has Spark's default, which is many megabytes of documents for each worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="sentrail-")
    return _own_dir


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder once and return a DataFrame that reads it there.

    The written table cuts the lineage, survives lost executors and gives every
    later reader the same rows. ``release`` removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return owned(spark.read.schema(df.schema).parquet(path), path)


def owned(df: DataFrame, path: str) -> DataFrame:
    """``df``, which reads a folder in the shared one that ``release``, or the end of a ``scratch``, is to remove."""
    df._sentrail_path = path
    for s in _scopes:
        s.append(df)
    return df


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Remove at the end whatever ``materialize`` wrote meanwhile; what is taken out of the list stays."""
    tables: list[DataFrame] = []
    _scopes.append(tables)
    try:
        yield tables
    finally:
        _scopes[:] = [s for s in _scopes if s is not tables]
        release(*tables)


def release(*dfs: DataFrame) -> None:
    """Delete tables written by ``materialize`` that nothing will read again."""
    for df in dfs:
        path = getattr(df, "_sentrail_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
