"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that begin with it,
and the smallest member owns it. What a conversation owns is a suffix of its path: if it is the smallest
member of a node, it is that of every node further down. So the facts of a conversation are where its own
suffix starts, the tokens shared before it, the owner of the last node before it and whether its end is a
leaf of its own; a node's subtree is then one sum over its members. Tokens saved below a node are those
of its members' occurrences less those of owned nodes, and an owned node of a member cancels against
the occurrence of its owner, so a member adds the tokens between the node and its own suffix.

The smallest member of a node is a windowed minimum; it is worked out as an aggregate and a join, and prefixes by
carried sums (``functions.segments``), because a window would put a hot prefix or a hot conversation into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.segments import parted, running
from ..session import materialize
from .ordered import EMPTY, ordered_digests

#: A node is told by its depth and two sums of independent 64-bit hashes of (place, turn).
NODE = ["depth", "k1", "k2"]


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, pos, digest, n_bytes)``: the turns of each conversation, numbered from 1 by turn, null first.

    Turns of one number follow in the order of their digests. Null roles and texts are empty;
    rows of a null conversation belong to none and are left out.
    """
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256))
    rows = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(t).cast("long").alias("n_bytes")).where("conv is not null")
    order = ["turn", "digest"]  # ascending puts nulls first
    return materialize(running(parted(rows, ["conv"], order), ["conv"], order, {"pos": F.lit(1)}).select("conv", F.col("pos").cast("long").alias("pos"), "digest", "n_bytes"), "turns")


def with_shared_starts(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """``(conv, depth, digest, n_bytes)`` of conversations whose first h turns are those of conversation c - c % every, h = crc32(c) % most.

    All turns of that one if it has fewer, none if it is absent; then the conversation's own after its first h.
    """
    own = turns.groupBy("conv").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    start = own.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    counts = own.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    start = start.join(counts, "base", "left").withColumn("given", F.least("h", F.coalesce("n_base", F.lit(0))))
    first = turns.where(F.col("pos") < most).withColumnRenamed("conv", "base")
    given = start.select("conv", "base", "h").join(first, "base").where("pos <= h").select("conv", F.col("pos").alias("depth"), "digest", "n_bytes")
    rest = turns.where(F.col("pos") > F.crc32(F.col("conv").cast("string").cast("binary")) % most)
    rest = rest.join(start.select("conv", "h", "given"), "conv").select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("depth"), "digest", "n_bytes")
    return given.unionByName(rest)


def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``, a row for each node.

    ``turns``: ``(conv, depth from 1 without gaps, digest, n_bytes)``; ``convs``: ``(conv)``, distinct, those without
    turns included. A node is named by its smallest member and its depth. ``n_leaves`` counts the childless nodes of its
    subtree, ``saved_tokens`` sums there (members - 1) x bytes of the last turn, ``ends_sha256`` is the hash of the
    conversations that end at the node, ascending and joined by commas. No conversations give no nodes.
    """
    cell = lambda i: F.xxhash64(F.lit(i), "depth", "digest").cast("decimal(20,0)")
    rows = parted(turns.select("conv", F.col("depth").cast("long").alias("depth"), "n_bytes", cell(1).alias("h1"), cell(2).alias("h2")), ["conv"], ["depth"])
    rows = running(rows, ["conv"], ["depth"], {"k1": F.col("h1"), "k2": F.col("h2"), "upto": F.col("n_bytes")})
    path = rows.select("conv", "depth", *[F.col(k).cast("decimal(38,0)").alias(k) for k in ("k1", "k2")], "n_bytes", "upto")
    zero = F.lit(0).cast("decimal(38,0)")
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("upto"))
    path = path.unionByName(roots)

    size = path.groupBy("conv").agg(F.max("depth").alias("last"))
    path = materialize(path.join(size, "conv"), "path")
    owners = path.groupBy(*NODE).agg(F.min("conv").alias("owner"), F.max("last").alias("deepest"))
    marked = materialize(path.join(owners, NODE), "marked")
    leaf = (F.col("depth") == F.col("last")) & (F.col("deepest") == F.col("depth")) & (F.col("owner") == F.col("conv"))
    shared = F.max(F.when(F.col("owner") != F.col("conv"), F.struct("depth", "upto", "owner"))).alias("shared")
    facts = marked.groupBy("conv").agg(F.max(leaf.cast("int")).alias("leaf"), shared)
    facts = facts.select("conv", "leaf", F.coalesce(F.col("shared.depth") + 1, F.lit(0)).alias("own"), F.col("shared.upto").alias("shared_upto"), F.col("shared.owner").alias("above"))

    member = marked.join(facts, "conv")
    child = (F.col("own") <= F.col("depth") + 1) & (F.col("depth") < F.col("last"))
    saved = F.when(F.col("depth") < F.col("own"), F.col("shared_upto") - F.col("upto") + F.col("n_bytes")).otherwise(0)
    parent = F.when(F.col("depth") == 0, None).when(F.col("own") < F.col("depth"), F.col("conv")).otherwise(F.col("above"))
    nodes = member.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.max(F.when(F.col("conv") == F.col("owner"), parent)).alias("parent_conv_id"), F.count("*").alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
    )

    def lines(rows: Iterator[tuple]) -> Iterator[tuple[tuple, bytes]]:
        return ((row[:3], b"%d" % row[3]) for row in rows)

    ends = marked.where("depth = last").select(*NODE, "conv")
    hashes = ordered_digests(ends, NODE, ["conv"], lines, b",")
    out = nodes.join(hashes, NODE, "left").withColumn("ends_sha256", F.coalesce("sha256", F.lit(EMPTY)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
