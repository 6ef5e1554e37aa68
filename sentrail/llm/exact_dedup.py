"""Exact duplicates by progressive refinement: length, then a prefix hash, then a full hash.

The first pass counts normalised lengths, the second the prefix hashes of rows whose
length another row has, both summed up map-side. Groups of one are dropped level by
level; the third pass hashes full contents of rows in surviving groups alone (or of all
rows, where the caller wants every digest). Later steps see ids and digests only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .common import BROADCAST_KEYS, unused, without

PREFIX_CHARS = 64


def normalized(text: str) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", digest_all: bool = False) -> DataFrame:
    """``(doc, keep, group_size, kept, sha256)``, one row for each row of ``docs``.

    Rows of equal normalised text form a group; its row of least ``doc`` is kept (null
    ids come last; of rows that repeat this id too, one). ``sha256`` is null for rows
    that no earlier level left a partner, unless ``digest_all``. Null texts equal empty
    ones; very long texts are hashed whole; an empty table gives no rows; other columns
    are not looked at.
    """
    prefix = F.xxhash64(F.substring("t", 1, PREFIX_CHARS)).alias("prefix")
    texts = docs.select(F.col(doc).alias("doc"), normalized(text).alias("t")).withColumn("len", F.octet_length("t"))
    lengths = shared(texts.groupBy("len"), "lengths").select("len")
    same = texts.join(lengths, "len", "left_semi").select("len", prefix)
    live = shared(same.groupBy("len", "prefix"), "length-prefix").withColumn("live", F.lit(True))
    rows = texts.select("doc", "t", "len", prefix).join(live, ["len", "prefix"], "left")
    sha = F.sha2("t", 256)
    rows = rows.select("doc", F.coalesce("live", F.lit(False)).alias("live"), (sha if digest_all else F.when(F.col("live"), sha)).alias("sha256"))
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "digests")
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "uid")).alias("first")
    # written, so that the join below meets plain shuffles, of which a hot digest's can be split
    groups = materialize(rows.where("live").groupBy("sha256").agg(first, F.count("*").alias("n")).where("n > 1"), "equal")
    alone = F.col("first").isNull()
    same = F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.uid") == F.col("uid"))
    # rows that an earlier level left alone do not travel
    out = rows.where("live").join(groups, "sha256", "left").unionByName(rows.where("not live"), allowMissingColumns=True)
    return out.select("doc", F.when(alone, F.col("doc")).otherwise(F.col("first.doc")).alias("keep"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (alone | same).alias("kept"), "sha256")


def shared(groups: GroupedData, name: str) -> DataFrame:
    """The keys of groups of more than one row, written once; sent to every executor if they are few."""
    keys = materialize(groups.agg(F.count("*").alias("n")).where("n > 1").drop("n"), name)
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def drop_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal normalised texts, all columns as they are.

    The row of least id stays; null ids come last, and of rows that repeat both id and text
    one stays. Null texts equal empty ones; any other column may have any name. Only ids of
    dropped rows travel, with their digests where ids repeat.
    """
    with scratch() as tables:
        groups = materialize(exact_groups(docs, doc, text).select("doc", "keep", "kept", "sha256"), "groups")
        tables.remove(groups)
    twins = groups.where("not kept").where(F.col("doc").eqNullSafe(F.col("keep"))).select("doc", "sha256").distinct()
    lost = groups.where("not kept").where(~F.col("doc").eqNullSafe(F.col("keep"))).select("doc").distinct()
    stay = groups.where("kept").select(F.col("doc").alias("__stay"))
    if twins.isEmpty() and lost.join(stay, F.col("doc").eqNullSafe(F.col("__stay")), "left_semi").isEmpty():
        return without(docs, lost.withColumnRenamed("doc", doc), [doc])
    # an id (or none) is repeated: tell its rows apart by their digest too
    sha = unused(docs, "__sha")
    both = docs.withColumn(sha, F.sha2(normalized(text), 256))
    lost = groups.where("not kept").where(~F.col("doc").eqNullSafe(F.col("keep"))).select(F.col("doc").alias(doc), F.col("sha256").alias(sha)).distinct()
    both = without(both, lost, [doc, sha])
    keys = twins.select(F.col("doc").alias(doc), F.col("sha256").alias(sha))
    cond = [both[doc].eqNullSafe(keys[doc]), both[sha] == keys[sha]]
    repeated = both.join(keys, cond, "left_semi").dropDuplicates([doc, sha])
    return without(both, keys, [doc, sha]).unionByName(repeated).drop(sha)
