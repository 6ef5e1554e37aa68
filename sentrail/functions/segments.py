"""Frames over the rows of a key in order, where one key may hold any share of the rows.

A plain window puts all rows of its key into one task. Here the rows of keys with more than HOT_ROWS are dealt by
range of key and order, so that a busy key lies in many parts; all other rows are part 0 of their key. Windows run
within (key, part), and what a part needs of those before it is carried: sums and the like as one row
(``carried``), or its last rows (``with_halo``). At most one key of a part goes on from the part before, so there are no
more carried rows than parts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import materialize

PART, HALO = "__part", "__halo"
HOT_ROWS = 1_000_000


@dataclass
class Segments:
    """``rows`` with their PART, of which ``hot`` (a written table) are those of keys in several parts."""

    rows: DataFrame
    hot: DataFrame
    key: list[str]
    order: list[str | Column]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.key, PART).orderBy(*self.order)

    def having(self, columns: Mapping[str, Column]) -> Segments:
        """With columns that each row has by itself."""
        return Segments(self.rows.withColumns(dict(columns)), self.hot.withColumns(dict(columns)), self.key, self.order)


def segmented(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], hot_rows: int = HOT_ROWS) -> Segments:
    """``df`` in segments; there are at most rows / ``hot_rows`` hot keys. ``order`` must tell the rows of a key apart."""
    busy = materialize(df.groupBy(*key).count().where(F.col("count") > hot_rows).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)]), "busy")
    if busy.isEmpty():
        alone = df.withColumn(PART, F.lit(0))
        return Segments(alone, alone.where(F.lit(False)), list(key), list(order))
    cond = F.lit(True)
    for i, c in enumerate(key):
        cond = cond & df[c].eqNullSafe(busy[f"__k{i}"])
    hot = parted(df.join(busy, cond, "left_semi"), key, order)
    cold = df.join(busy, cond, "left_anti").withColumn(PART, F.lit(0))
    return Segments(cold.unionByName(hot), hot, list(key), list(order))


def parted(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``df`` written once, dealt by range of ``key`` and ``order``, with its place PART: parts ascend with key and order."""
    return materialize(df.repartitionByRange(*key, *order).withColumn(PART, F.spark_partition_id()), "parted")


def carried(hot: DataFrame, key: Sequence[str], totals: Mapping[str, Column], merge: Mapping[str, Column]) -> DataFrame:
    """``(key, PART, totals...)`` for each part that a key goes on into: ``totals`` of each part before, put together by ``merge``."""
    each = hot.groupBy(*key, PART).agg(*[c.alias(n) for n, c in totals.items()])
    before = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*key, PART, F.count("*").over(before).alias("__before"), *[c.over(before).alias(n) for n, c in merge.items()]).where("__before > 0").drop("__before")


def with_carried(rows: DataFrame, state: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``state``, which has at most one row for each part; null where no part goes before."""
    named = state.withColumnsRenamed({c: f"__s_{c}" for c in (*key, PART)})
    cond = rows[PART] == named[f"__s_{PART}"]
    for c in key:
        cond = cond & rows[c].eqNullSafe(named[f"__s_{c}"])
    return rows.join(F.broadcast(named), cond, "left").drop(*[f"__s_{c}" for c in (*key, PART)])


def running(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, Column]) -> DataFrame:
    """``rows`` of ``parted`` with the sum of each of ``sums`` up to and with the row, in ``order`` within ``key``."""
    local = Window.partitionBy(*key, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = {f"__c_{n}": F.sum(c) for n, c in sums.items()}
    state = carried(rows, key, before, {n: F.sum(n) for n in before})
    out = with_carried(rows.withColumns({n: F.sum(c).over(local) for n, c in sums.items()}), state, key)
    return out.withColumns({n: F.col(n) + F.coalesce(F.col(f"__c_{n}"), F.lit(0)) for n in sums}).drop(*before)


def with_halo(s: Segments, k: int) -> DataFrame:
    """The rows of ``s`` and, marked HALO, before each part that a key goes on into the last ``k`` rows of that key before it."""
    parts = s.hot.groupBy(*s.key, PART).agg(F.lit(1).alias("__one"))
    after = F.lead(PART).over(Window.partitionBy(*s.key).orderBy(PART))
    goes_on = parts.select(*s.key, PART, after.alias("__next")).where("__next is not null")
    ends = with_carried(s.hot, goes_on, s.key).where("__next is not null")  # no more rows than parts are broadcast
    back = Window.partitionBy(*s.key, PART).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in s.order])
    ends = ends.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= k)
    columns = s.hot.columns
    along = Window.partitionBy(*s.key).orderBy(PART, F.desc("__back"))
    last = F.collect_list(F.struct(*columns)).over(along.rowsBetween(1 - k, 0))  # k rows of a part at most, so a key has k times its parts
    tails = ends.withColumn("__tail", last).where("__back = 1").select(F.col("__next"), F.explode("__tail").alias("__row"))
    halo = tails.select(*[F.col("__next").alias(PART) if c == PART else F.col(f"__row.{c}").alias(c) for c in columns], F.lit(True).alias(HALO))
    return s.rows.withColumn(HALO, F.lit(False)).unionByName(halo)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` with the place of each row, from 1, in ``order`` over the whole table; only counts of parts come together."""
    rows = parted(df, [], order)
    counts = rows.groupBy(PART).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(PART).alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"))  # a row a part
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(PART).orderBy(*order)))
    return out.join(F.broadcast(counts), F.col(PART) == F.col("__of")).withColumn(name, F.col(name) + F.col("__before")).drop(PART, "__of", "__before")
