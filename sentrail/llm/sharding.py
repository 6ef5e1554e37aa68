"""Extendible hashing of rows into shards of bounded bytes.

A row's address is the 60-bit prefix of the MD5 of its key; rows that share a
key also get bits from their ordinal, used only below an address that alone is
over the limit. The directory is indexed by leading address bits. A bucket over
its byte limit splits on the next bit, and only that bucket does, until every
shard fits; so depths differ between shards.

The directory is worked out on sums, never on rows: sizes are added up (map-side
first) in cells of a few bits below the expected depth, and the splits of one
top prefix are found from its at most 2^TOP_SPAN cells. Cells still too large are
refined from their own rows only, round by round.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import unused

ADDRESS_BITS = 60
#: Cells below one top prefix that one task looks at: 2 to this power.
TOP_SPAN = 14
#: Bits counted below the depth at which an average shard fits.
SLACK = 4


def address(key: str) -> Column:
    """The leading 60 bits of the key's MD5; a null key counts as the text '~null'."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("~null"))), 1, 15), 16, 10).cast("long")


def _descend(limit: int, base: int, depth: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Splits of one prefix of ``base`` bits, from sums by prefix of ``depth`` bits."""

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        level = {c: (s, n) for c, s, n in zip(pdf["cell"].tolist(), pdf["size"].tolist(), pdf["n"].tolist(), strict=True)}
        levels = [level]  # by depth, from ``depth`` up to ``base``
        for _ in range(depth - base):
            up: dict[int, tuple[int, int]] = {}
            for k, (s, n) in level.items():
                s0, n0 = up.get(k >> 1, (0, 0))
                up[k >> 1] = (s0 + s, n0 + n)
            levels.append(level := up)
        out = []
        for cell in levels[0]:
            for d in range(base, depth + 1):
                s, n = levels[depth - d][cell >> (depth - d)]
                if s <= limit or n == 1 or d == depth:
                    out.append((keys[0], cell, d, s, s <= limit or n == 1))
                    break
        return pd.DataFrame(out, columns=["prefix", "cell", "depth", "shard_bytes", "fits"])

    return run


def bit_text(bits: str, depth: Column) -> Column:
    """The first ``depth`` address bits as text."""
    return F.substring(F.lpad(F.bin(bits), ADDRESS_BITS, "0"), F.lit(1), depth)


def assign_shards(df: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """``(key, n_bytes, shard, depth, shard_bytes)``, one row for each row of ``df``.

    ``shard`` is the bit string of the bucket ('' if all rows fit one). Every shard
    has at most ``limit`` bytes, unless it is one row that alone has more. Null keys
    share an address; null sizes count 0; rows that repeat a key share its address
    and part by the bits of their ordinal once the address alone is over the limit;
    an empty table gives no rows. Other columns of ``df`` are not looked at.
    """
    if limit < 1:
        raise ValueError("the byte limit must be at least 1")
    rows = df.select(F.col(key).alias("key"), address(key).alias("a"), F.coalesce(size.cast("long"), F.lit(0)).alias("n_bytes"))
    rows = materialize(rows.withColumn("o", F.monotonically_increasing_id()), "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    expected = max(0, math.ceil(math.log2(max(1, total / limit))))
    todo = rows.withColumns({"b": F.xxhash64("a", "o").bitwiseAND(F.lit((1 << ADDRESS_BITS) - 1)), "prefix": F.lit("")})
    done: list[DataFrame] = []
    bits, used, step = "a", 0, expected + SLACK
    while True:
        depth = min(ADDRESS_BITS, used + step)
        base = max(used, depth - TOP_SPAN)
        cells = todo.withColumn("cell", F.shiftright(F.col(bits), ADDRESS_BITS - depth))
        sums = cells.groupBy("prefix", "cell").agg(F.sum("n_bytes").alias("size"), F.count("*").alias("n"))
        top = F.shiftright("cell", depth - base).alias("top")
        tree = sums.groupBy("prefix", top).applyInPandas(_descend(limit, base, depth), "prefix string, cell long, depth int, shard_bytes long, fits boolean")
        tree = materialize(tree, "shard-tree")
        last = bits == "b" and depth == ADDRESS_BITS
        named = cells.join(tree, ["prefix", "cell"])
        shard = F.concat("prefix", bit_text(bits, F.col("depth")))
        done.append((named if last else named.where("fits")).select("key", "n_bytes", shard.alias("shard"), F.length(shard).alias("depth"), "shard_bytes"))
        if last or tree.where("not fits").isEmpty():
            break
        deep = named.where("not fits").select("key", "a", "b", "o", "n_bytes", "prefix")
        if depth < ADDRESS_BITS:
            used, step = depth, 2 * SLACK
        else:  # one address alone is over the limit: go on with the rows' own bits
            deep = deep.withColumn("prefix", bit_text("a", F.lit(ADDRESS_BITS)))
            bits, used, step = "b", 0, TOP_SPAN
        todo = materialize(deep, "shard-deep")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def write_shards(df: DataFrame, key: str, size: Column, limit: int, path: str) -> DataFrame:
    """Write ``df`` as Parquet, one folder ``shard=<bits>`` for each shard, and return the directory.

    Rows travel once, by shard; the row's key must name it uniquely here. Every column of
    ``df`` is written, whatever its name; where one is called 'shard', the folders are named
    'shard_=<bits>'.
    """
    name, of = unused(df, "shard"), unused(df, "__key")
    shards = assign_shards(df, key, size, limit).select(F.col("key").alias(of), F.concat(F.lit("b"), "shard").alias(name), "shard_bytes")
    full = df.join(shards.drop("shard_bytes"), df[key].eqNullSafe(shards[of])).drop(of)
    full.repartition(name).write.partitionBy(name).parquet(path)
    return shards.groupBy(F.col(name).alias("shard")).agg(F.max("shard_bytes").alias("shard_bytes"), F.count("*").alias("n_rows"))
