"""Searches on the graph whose state is a row a vertex: shortest paths from both ends, hops through shared attributes, sampled betweenness."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release, scratch
from .network import SHARED, generate_network, path_risk, undirected
from .vectors import WIDTH, dependencies, in_blocks

# shortest paths ------------------------------------------------------------------


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 10) -> DataFrame:
    """``(source, target, length, path)`` of each of ``pairs`` (source, target): a least undirected path, of equals the least by ids, or -1 and null.

    All pairs go on together, each from both of its ends; a round takes the end whose frontier has fewer rows. A vertex is
    one row an end and pair, ``(pair, side, v, d)``. A pair stops when its ends meet. The path is read back at the end:
    what lies on a shortest one is found from the middle to the source, then the least next vertex is
    taken step by step.
    """
    kind = edges.schema["src"].dataType.simpleString()
    with scratch() as tables:
        und = materialize(undirected(edges), "und")
        asked = materialize(pairs.select(F.col("source").cast(kind).alias("source"), F.col("target").cast(kind).alias("target")).distinct().withColumn("pair", F.monotonically_increasing_id()), "pairs")
        ends = F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("v"), F.lit(0).alias("d")) for s, c in ((0, "source"), (1, "target"))]))
        seen = materialize(asked.where("source is not null and target is not null").select("pair", ends), "seen")
        reach, met = [0, 0], None
        for length in range(max_depth + 1):
            now = meeting(seen, reach).withColumn("length", F.lit(length))
            met = materialize(now if met is None else met.unionByName(now.join(met, "pair", "left_anti")), "met")
            if length == max_depth:
                break
            front = seen.where((F.col("side") == 0) & (F.col("d") == reach[0]) | (F.col("side") == 1) & (F.col("d") == reach[1])).join(met, "pair", "left_anti")
            rows = {r["side"]: r["count"] for r in front.groupBy("side").count().collect()}  # two rows
            if len(rows) < 2:  # each open pair has an end that goes nowhere
                break
            side = min(rows, key=lambda s: (rows[s], s))
            step = front.where(F.col("side") == side).join(und, F.col("v") == F.col("src")).select("pair", "side", F.col("dst").alias("v")).distinct()
            new = step.join(seen, ["pair", "side", "v"], "left_anti").withColumn("d", F.lit(reach[side] + 1))
            seen, reach[side] = materialize(seen.unionByName(new.select(*seen.columns)), "seen"), reach[side] + 1
        out = materialize(asked.join(read_back(und, seen, met, max_depth), "pair", "left").select("source", "target", F.coalesce("length", F.lit(-1)).alias("length"), "path"), "shortest")
        tables.remove(out)
    return out


def meeting(seen: DataFrame, reach: Sequence[int]) -> DataFrame:
    """The pairs whose newest levels share a vertex."""
    at = lambda s: seen.where((F.col("side") == s) & (F.col("d") == reach[s])).select("pair", "v")
    return at(0).join(at(1), ["pair", "v"], "left_semi").select("pair").distinct()


def read_back(und: DataFrame, seen: DataFrame, met: DataFrame, max_depth: int) -> DataFrame:
    """``(pair, length, path)`` of the pairs that met, by levels: those on a shortest path before the middle, and after it all that the target has reached."""
    live = seen.join(met, "pair")
    far = live.where("side = 1").select("pair", "v", (F.col("length") - F.col("d")).alias("level"))
    near = live.where("side = 0").select("pair", "v", F.col("d").alias("level"))
    middle = materialize(near.join(far, ["pair", "v", "level"], "left_semi"), "middle")
    first = middle.groupBy("pair").agg(F.max("level").alias("top"))
    middle = middle.join(first, "pair").where("level = top").drop("top")
    levels = [middle]
    top = middle.agg(F.max("level")).first()[0] or 0
    for level in range(top - 1, -1, -1):
        above = levels[-1].where(F.col("level") == level + 1).select("pair", F.col("v").alias("dst"))
        on = near.where(F.col("level") == level).join(und, F.col("v") == F.col("src")).join(above, ["pair", "dst"], "left_semi").select("pair", "v", "level").distinct()
        levels.append(materialize(on.unionByName(middle.where(F.col("level") == level)).distinct(), "on-path"))
    on_path = levels[0]
    for more in levels[1:]:
        on_path = on_path.unionByName(more)
    after = far.join(first, "pair").where("level > top").drop("top")
    on_path = materialize(on_path.unionByName(after).distinct(), "on-paths")
    now = materialize(on_path.where("level = 0").join(met, "pair").select("pair", "length", F.col("v"), F.array("v").alias("path")), "walk")
    for level in range(1, max_depth + 1):
        going = now.where(F.col("length") >= level)
        if going.isEmpty():
            break
        ahead = on_path.where(F.col("level") == level).select("pair", F.col("v").alias("dst"))
        least = going.join(und, F.col("v") == F.col("src")).join(ahead, ["pair", "dst"], "left_semi").groupBy("pair").agg(F.min("dst").alias("next"))
        walked = going.join(least, "pair").select("pair", "length", F.col("next").alias("v"), F.array_append("path", F.col("next")).alias("path"))
        now = materialize(walked.unionByName(now.where(F.col("length") < level)), "walk")
    return now.select("pair", "length", "path")


# shared attributes as nodes --------------------------------------------------------


def attribute_stars(nodes: DataFrame, rules: Sequence[tuple[str, str, float]] = SHARED) -> DataFrame:
    """``(id, star, rule, relationship_type, confidence)``: each node beside the attribute values that others share with it.

    A star stands for all pairs of its members; it has a row for each of them.
    """
    parts = [F.struct(F.lit(i).alias("rule"), F.lit(kind).alias("relationship_type"), F.lit(confidence).alias("confidence"), F.element_at("attributes", name).alias("value")) for i, (name, kind, confidence) in enumerate(rules)]
    rows = nodes.select("id", F.inline(F.array(*parts))).where("value <> ''").withColumn("star", F.concat_ws("=", "relationship_type", "value")).drop("value").distinct()
    shared = rows.groupBy("star").agg(F.count("*").alias("n")).where("n > 1").select("star")
    return rows.join(shared, "star").select("id", "star", "rule", "relationship_type", "confidence")


def neighbours_through(edges: DataFrame, stars: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    """``(id, hops)`` within ``depth`` hops of any id of ``start``, over undirected edges or from a node to another of one star.

    A star is opened once, by the first node that reaches it, so hops cost its members and not their pairs.
    """
    with scratch() as tables:
        und, stars = materialize(undirected(edges), "und"), materialize(stars.select("id", "star"), "stars")
        seen = materialize(start.select("id").distinct().withColumn("hops", F.lit(0)), "seen")
        opened = materialize(stars.select("star").limit(0), "opened")
        for h in range(1, depth + 1):
            front = seen.where(F.col("hops") == h - 1).select("id")
            new_stars = materialize(front.join(stars, "id").select("star").distinct().join(opened, "star", "left_anti"), "open")
            direct = front.join(und, F.col("id") == F.col("src")).select(F.col("dst").alias("id"))
            new = direct.unionByName(stars.join(new_stars, "star").select("id")).distinct().join(seen.select("id"), "id", "left_anti")
            seen, opened = materialize(seen.unionByName(new.withColumn("hops", F.lit(h))), "seen"), materialize(opened.unionByName(new_stars), "opened")
        tables.remove(seen)
    return seen.where("hops > 0")


def propagate_through(vertices: DataFrame, edges: DataFrame, stars: DataFrame, source: object, max_hops: int = 3, decay: float = 0.5) -> DataFrame:
    """``network.propagate_risk`` with stars for inferred pairs: ``(id, hops, risk)``.

    Inferred edges come after all others and in the order of their rules, with weight 1; all pairs of a star
    have its confidence, so which member reaches a node does not matter.
    """
    with scratch() as tables:
        e = edges.select("src", "dst", "ord", "confidence", "weight")
        both = materialize(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ord", "confidence", "weight")), "both")
        stars = materialize(stars.select("id", "star", "rule", "confidence"), "stars")
        risk = vertices.where(F.col("id") == source).select("id", F.lit(0).alias("hops"), F.col("risk_score").alias("risk"))
        base, seen = risk.select(F.col("risk").alias("base")), materialize(risk, "risk")
        opened = materialize(stars.select("star").limit(0), "opened")
        for h in range(1, max_hops + 1):
            front = seen.where(F.col("hops") == h - 1).select("id")
            direct = front.select(F.col("id").alias("src")).join(both, "src").select(F.col("dst").alias("id"), F.struct(F.lit(0).alias("late"), F.col("ord").cast("long").alias("ord"), "confidence", "weight").alias("e"))
            new_stars = materialize(front.join(stars, "id").select("star").distinct().join(opened, "star", "left_anti"), "open")
            through = stars.join(new_stars, "star").select("id", F.struct(F.lit(1).alias("late"), F.col("rule").cast("long").alias("ord"), "confidence", F.lit(1.0).alias("weight")).alias("e"))
            first = direct.unionByName(through).join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min_by("e", F.struct("e.late", "e.ord")).alias("e")).crossJoin(F.broadcast(base))  # base is one row
            new = first.select("id", F.lit(h).alias("hops"), (F.col("base") * decay**h * F.col("e.confidence") * F.col("e.weight")).alias("risk"))
            seen, opened = materialize(seen.unionByName(new), "risk"), materialize(opened.unionByName(new_stars), "opened")
        tables.remove(seen)
    return seen


# betweenness ------------------------------------------------------------------------


def sampled_betweenness(vertices: DataFrame, edges: DataFrame, epsilon: float = 0.02, failure: float = 0.05, batch: int = 64, seed: int = 1) -> DataFrame:
    """``(id, betweenness, error, sources)`` of every vertex, from sources drawn without replacement until all bounds are small.

    A source's dependency on a vertex is at most n - 2 of the n vertices; with the mean of r of them the share
    b / (n (n - 2) / 2) is known within ``error`` for all vertices at once but for a chance of ``failure``, by the least of
    Hoeffding's and the empirical Bernstein bound with a union over vertices and rounds. Batches double until every
    ``error`` is at most ``epsilon``; if all vertices have been sources by then, values are exact and errors 0. The state is
    a row of numbers a vertex, one for each of some WIDTH sources; between batches two sums a vertex are kept.
    """
    with scratch() as tables:
        order = F.struct(F.xxhash64("id", F.lit(seed)), "id")
        ids = materialize(vertices.select("id").where("id is not null").distinct(), "ids")
        n = ids.count()
        und = materialize(undirected(edges), "und")
        sums = materialize(ids.select("id", F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), "sums")
        nodes, graph, blocks = in_blocks(und, ids, WIDTH)
        left, drawn, rounds = ids, 0, 0
        while drawn < n:
            rounds += 1
            take = min(batch * (1 << (rounds - 1)), n - drawn)
            some = materialize(left.orderBy(order).limit(take), "sources")
            left = materialize(left.join(some, "id", "left_anti"), "rest")
            for k in range(-(-take // WIDTH)):  # so many numbers a vertex at once
                part = some.where(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(-(-take // WIDTH))) == k)
                more = dependencies(nodes, graph, blocks, part)
                nxt = materialize(sums.join(more, "id", "left").select("id", (F.col("s") + F.coalesce("s2", F.lit(0.0))).alias("s"), (F.col("q") + F.coalesce("q2", F.lit(0.0))).alias("q")), "sums")
                release(sums, more)
                sums = nxt
            drawn += take
            error = error_bound(drawn, n, failure / (rounds * (rounds + 1)))
            worst = sums.agg(F.max(error)).first()[0]
            if worst is None or worst <= epsilon:
                break
        known = F.lit(0.0) if drawn == n else error_bound(max(drawn, 1), n, failure / (max(rounds, 1) * (max(rounds, 1) + 1)))
        out = materialize(sums.select("id", (F.col("s") * (n / max(drawn, 1)) / 2).alias("betweenness"), known.alias("error"), F.lit(drawn).cast("long").alias("sources")), "betweenness")
        tables.remove(out)
    return out


def error_bound(drawn: int, n: int, failure: float) -> F.Column:
    """Of the mean share of a vertex after ``drawn`` of ``n`` sources, from its sum ``s`` and sum of squares ``q``; both bounds hold for draws without replacement too."""
    if drawn >= n or n < 3:
        return F.lit(0.0)
    log = math.log(4 * n / failure)
    mean, square = F.col("s") / (drawn * (n - 2)), F.col("q") / (drawn * (n - 2) ** 2)
    spread = F.greatest(square - mean * mean, F.lit(0.0)) * (drawn / max(drawn - 1, 1))
    bernstein = F.sqrt(spread * (2 * log / drawn)) + 7 * log / (3 * max(drawn - 1, 1))
    left = 1 - (drawn - 1) / n  # Serfling's factor
    return F.least(F.lit(math.sqrt(left * log / (2 * drawn))), bernstein)


def network_with_stars(nodes: DataFrame, edges: DataFrame, payments: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, stars): ``network.generate_network`` without inferred pairs, and the shared attributes that stand for them."""
    v, e = generate_network(nodes, edges, payments, rules=())
    return v, e, materialize(attribute_stars(v), "stars")


def star_links(stars: DataFrame) -> DataFrame:
    """``(relationship_type, links)``: how many inferred edges the stars stand for."""
    sizes = stars.groupBy("relationship_type", "star").agg(F.count("*").alias("n"))
    return sizes.groupBy("relationship_type").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("links"))


# the first paths in order ---------------------------------------------------------


def first_trails(edges: DataFrame, source: object, depth: int = 2, limit: int = 100, cap: int | None = None) -> DataFrame:
    """The first ``limit`` rows of ``network.trails`` by (distance, id, path), without listing the others.

    Level by level: as many ends as are still wanted are taken in order of their ids; backward steps say which vertices
    lead to them, so that forward steps go nowhere else, and of the prefixes (end, path) only the first ``cap`` are kept at
    each step. What is dropped comes after all that stays, so the result is exact once it is full; where it is not, the
    cap is doubled or the next ends are taken.
    """
    with scratch() as tables:
        e = edges.select("src", "dst", "edge_id", "relationship_type")
        both = materialize(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_id", "relationship_type").where("src <> dst")), "both")
        start = both.where(F.col("src") == source)
        out = materialize(start.select(F.col("dst").alias("id"), F.lit(1).alias("distance"), "relationship_type", F.array("edge_id").alias("path")).orderBy("id", "path").limit(limit), "trails")
        reach = [None, materialize(start.select(F.col("dst").alias("v")).distinct(), "reach")]
        have = out.count()
        for d in range(2, depth + 1):
            if have >= limit:
                break
            reach.append(materialize(reach[-1].join(both, F.col("v") == F.col("src")).select(F.col("dst").alias("v")).distinct(), "reach"))
            ends, take = reach[d], limit - have
            while have < limit:
                some = materialize(ends.orderBy("v").limit(take), "ends")
                if some.isEmpty():
                    break
                top = some.agg(F.max("v")).first()[0]
                found = trails_to(both, source, reach, some, d, limit - have, cap or 4 * limit)
                out = materialize(out.unionByName(found), "trails")
                have += found.count()
                ends, take = ends.where(F.col("v") > top), 2 * take
        tables.remove(out)
    return out.orderBy("distance", "id", "path")


def trails_to(both: DataFrame, source: object, reach: Sequence[DataFrame], ends: DataFrame, d: int, wanted: int, cap: int) -> DataFrame:
    """The first ``wanted`` trails of ``d`` edges from the source to ``ends``, by end and path."""
    kind = both.schema["src"].dataType
    leads = {d: materialize(ends.select(F.col("v").alias("t"), "v"), "leads")}
    for i in range(d - 1, 0, -1):
        before = leads[i + 1].withColumnRenamed("v", "dst").join(both.select("src", "dst"), "dst").select("t", F.col("src").alias("v")).distinct()
        leads[i] = materialize(before.join(reach[i], "v", "left_semi").select("t", "v"), "leads")
    while True:
        rows, cut = ends.select(F.col("v").alias("t"), F.lit(source).cast(kind).alias("at"), F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("relationship_type")), False
        for i in range(1, d + 1):
            step = rows.select("t", "at", "path").join(both, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("edge_id")))
            to = leads[i].select(F.col("t").alias("__t"), F.col("v").alias("__v"))
            step = step.join(to, (F.col("t") == F.col("__t")) & (F.col("dst") == F.col("__v")), "left_semi")
            step = step.select("t", F.col("dst").alias("at"), F.array_append("path", F.col("edge_id")).alias("path"), "relationship_type")
            rows = materialize(step.orderBy("t", "path").limit(cap), "prefixes")
            cut = cut or rows.count() == cap
        if not cut or rows.count() >= wanted:
            return rows.orderBy("t", "path").limit(wanted).select(F.col("t").alias("id"), F.lit(d).alias("distance"), "relationship_type", "path")
        cap *= 2


def trail_counts(edges: DataFrame, source: object, depth: int = 3) -> DataFrame:
    """``(distance, paths)``: how many trails of 1, 2 and (at most) 3 edges there are, from numbers of edges and not from the trails."""
    if depth > 3:
        raise ValueError("trails of more than three edges are not counted")
    e = edges.select("src", "dst", "edge_id")
    both = materialize(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_id").where("src <> dst")), "both")
    ends = materialize(both.groupBy("src").agg(F.count("*").alias("n")), "ends")
    pairs = materialize(both.groupBy("src", "dst").agg(F.count("*").alias("m")), "pairs")
    first = pairs.where(F.col("src") == source).select(F.col("dst").alias("v"), F.col("m").alias("m1"))
    one = first.agg(F.lit(1).alias("distance"), F.coalesce(F.sum("m1"), F.lit(0)).alias("paths"))
    if depth == 1:
        return one
    here = F.col("src") == F.lit(source)
    # from v on to w, by any edge but the first: which leads from v to the source, or is a loop at the source
    second = first.join(pairs, F.col("v") == F.col("src")).select("v", F.col("dst").alias("w"), (F.col("m1") * (F.col("m") - F.when(F.col("dst") == source, 1).otherwise(0))).alias("n2"), "m1", "m", here.alias("stays"))
    second = materialize(second, "second")
    two = second.agg(F.lit(2).alias("distance"), F.coalesce(F.sum("n2"), F.lit(0)).alias("paths"))
    if depth == 2:
        return one.unionByName(two)
    # the third edge is neither of the two: the second always touches w, the first does where w is the source or the second is a loop
    third = second.join(ends, F.col("w") == F.col("src")).select((F.col("n2") * (F.col("n") - 1 - F.when((F.col("w") == source) | (F.col("w") == F.col("v")), 1).otherwise(0))).alias("n3"))
    three = third.agg(F.lit(3).alias("distance"), F.coalesce(F.sum("n3"), F.lit(0)).alias("paths"))
    return one.unionByName(two).unionByName(three)


def ranked_path_risk(vertices: DataFrame, edges: DataFrame, source: object, depth: int = 3, limit: int = 50) -> DataFrame:
    """``network.path_risk`` from the first trails: as risk falls with the distance, they are the highest. Trails back to the source do not count."""
    base = vertices.where(F.col("id") == source).select(F.col("risk_score").alias("base")).first()
    if base is None or not base["base"] or base["base"] < 0:  # all risks are equal, or grow with the distance
        return path_risk(vertices, edges, source, depth, limit)
    back = trail_counts(edges, source, min(depth, 3)) if depth <= 3 else None
    extra = limit
    while True:
        t = first_trails(edges, source, depth, limit + extra)
        rows = materialize(t.where(F.col("id") != source).select("id", "distance", (F.lit(base["base"]) / F.col("distance")).alias("propagated_risk"), "path"), "path-risk")
        total = t.count()
        if rows.count() >= limit or total < limit + extra or (back is not None and total >= back.agg(F.sum("paths")).first()[0]):
            return rows.orderBy(F.desc("propagated_risk"), "id", "path").limit(limit)
        extra *= 4
