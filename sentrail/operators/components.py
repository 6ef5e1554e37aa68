"""Connected components by randomised contraction.

Each round every vertex moves to the neighbour (or itself) of least random
priority, follows that choice once more, and the edges are rewritten to the
chosen vertices. A constant share of the vertices disappears each round
whatever the order of their ids, so a chain of n vertices takes O(log n)
rounds. Only edges still between different vertices are carried on, and each
round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release, scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every vertex on an edge; component is the least id reachable.

    Rows with a null end are ignored; self loops give their vertex a row; repeated
    and reversed edges change nothing. An empty table gives an empty result. Hot
    vertices are reduced by map-side aggregation and split by adaptive skew joins. The
    result is a table in the shared folder; nothing else is left there.
    """
    with scratch() as tables:
        out = materialize(_components(edges, src, dst, max_rounds), "cc")
        tables.remove(out)
    return out


def _components(edges: DataFrame, src: str, dst: str, max_rounds: int) -> DataFrame:
    e0 = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    # both directions from one pass, as the edges may be costly to work out
    e0 = e0.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    e = materialize(e0.distinct(), "cc-edges")
    labels = materialize(e.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct(), "cc-labels")
    live = materialize(e.where("u <> v"), "cc-live")
    release(e)
    for i in range(max_rounds):
        if live.isEmpty():
            break
        rank = lambda c, i=i: F.struct(F.xxhash64(F.col(c), F.lit(i)).alias("h"), F.col(c).alias("x"))
        choice = live.groupBy("u").agg(F.min(rank("v")).alias("m"))
        choice = choice.select("u", F.least(F.col("m"), rank("u"))["x"].alias("p"))
        choice = materialize(choice, "cc-choice")
        again = choice.select(F.col("u").alias("p"), F.col("p").alias("q"))
        step = materialize(choice.join(again, "p").select("u", F.col("q").alias("p")), "cc-step")
        moved = (
            live.join(step, "u")
            .select(F.col("p").alias("u"), "v")
            .join(step.select(F.col("u").alias("v"), F.col("p").alias("w")), "v")
            .where("u <> w")
            .select("u", F.col("w").alias("v"))
            .distinct()
        )
        new_live = materialize(moved, "cc-live")
        new_labels = labels.join(step.withColumnRenamed("u", "root"), "root", "left").select("id", F.coalesce("p", "root").alias("root"))
        new_labels = materialize(new_labels, "cc-labels")
        release(live, labels, choice, step)
        live, labels = new_live, new_labels
    else:
        if not live.isEmpty():
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    least = labels.groupBy("root").agg(F.min("id").alias("component"))
    return labels.join(least, "root").select("id", "component")
