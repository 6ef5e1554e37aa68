"""Graph operators over vertices ``(id, name, entity_type, risk_score, is_sanctioned, is_pep)`` and edges ``(src, dst, id, amount, ts)``."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ladder, ratio
from ..session import materialize, release


def graph(tx: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The transaction multigraph; payments without both ends are left out."""
    edges = tx.where("sender_entity_id is not null and receiver_entity_id is not null").select(F.col("sender_entity_id").alias("src"), F.col("receiver_entity_id").alias("dst"), "id", "amount", F.col("transaction_date").alias("ts"))
    return entities.select("id", "name", "entity_type", "risk_score", "is_sanctioned", "is_pep"), edges


def circular_flows(edges: DataFrame, min_amount: float = 10000, distinct_cycles: bool = False) -> DataFrame:
    """Every a -> b -> c -> a of payments of at least ``min_amount``, in all three rotations unless ``distinct_cycles``.

    Triangles are found on pairs of entities, and only those that close are spread out over
    their parallel payments.
    """
    e = edges.where(F.col("amount") >= min_amount).select("src", "dst", "id", "amount")
    pairs = e.select("src", "dst").distinct()
    p1, p2, p3 = (pairs.select(F.col("src").alias(x), F.col("dst").alias(y)) for x, y in (("src1", "src2"), ("src2", "src3"), ("src3", "src1")))
    t = p1.join(p2, "src2").join(p3, ["src3", "src1"])
    for i, j in ((1, 2), (2, 3), (3, 1)):
        t = t.join(e.select(F.col("src").alias(f"src{i}"), F.col("dst").alias(f"src{j}"), F.col("id").alias(f"id{i}"), F.col("amount").alias(f"amount{i}")), [f"src{i}", f"src{j}"])
    if distinct_cycles:
        t = t.where("id1 <= id2 and id1 <= id3")
    total = F.col("amount1") + F.col("amount2") + F.col("amount3")
    return t.select(F.col("src1").alias("entity_a"), F.col("src2").alias("entity_b"), F.col("src3").alias("entity_c"), total.alias("total_flow"), (total / 3).alias("avg_flow"), F.array("id1", "id2", "id3").alias("transaction_ids"))


def pair_flows(edges: DataFrame, min_flow: float = 10000) -> DataFrame:
    g = edges.groupBy("src", "dst").agg(F.count("*").alias("tx_count"), F.sum("amount").alias("total_flow"), F.avg("amount").alias("avg_flow"), F.stddev("amount").alias("std_flow"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.where(F.col("total_flow") >= min_flow)


def reciprocal_flows(edges: DataFrame, min_flow: float = 10000, min_ratio: float = 0.7) -> DataFrame:
    """Pairs that pay each other nearly as much, in both orientations."""
    f = pair_flows(edges, min_flow).select("src", "dst", "total_flow")
    back = f.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("total_flow").alias("reverse_flow"))
    j = f.join(back, ["src", "dst"])
    low, high = F.least("total_flow", "reverse_flow"), F.greatest("total_flow", "reverse_flow")
    return j.withColumns({"reciprocity": ratio(low, high), "net_flow": F.col("total_flow") - F.col("reverse_flow")}).where(F.col("reciprocity") >= min_ratio)


def pass_through(edges: DataFrame, min_ratio: float = 0.9, min_incoming: int = 3) -> DataFrame:
    """Entities that pay out about what they take in."""
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("amount").alias("total_in"), F.count("*").alias("count_in"))
    o = edges.groupBy(F.col("src").alias("id")).agg(F.sum("amount").alias("total_out"), F.count("*").alias("count_out"))
    r = i.join(o, "id").withColumn("passthrough_ratio", ratio(F.col("total_out"), F.col("total_in")))
    return r.where(F.col("passthrough_ratio").between(min_ratio, 1.1) & (F.col("count_in") >= min_incoming))


def degrees(edges: DataFrame) -> DataFrame:
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    return i.join(o, "id", "full").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def bridge_entities(vertices: DataFrame, edges: DataFrame, ranks: int = 50) -> DataFrame:
    """Entities of the ``ranks`` highest total degrees that have both directions.

    Ranks come from the distinct degrees, of which the top ones are few, not from a sort of all entities.
    """
    d = degrees(edges).where("in_degree > 0 and out_degree > 0").withColumn("total_degree", F.col("in_degree") + F.col("out_degree"))
    top = d.select("total_degree").distinct().orderBy(F.desc("total_degree")).limit(ranks)
    ranked = top.withColumn("degree_rank", F.dense_rank().over(W.orderBy(F.desc("total_degree"))))
    return d.join(F.broadcast(ranked), "total_degree").join(vertices, "id")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct().toDF("src", "dst")


def neighbours(edges: DataFrame, start: DataFrame, depth: int = 1, include_start: bool = False) -> DataFrame:
    """``(id, hops)`` within ``depth`` undirected hops of any id of ``start``."""
    und = materialize(undirected(edges), "und")
    seen = materialize(start.select("id").distinct().withColumn("hops", F.lit(0)), "seen")
    for h in range(1, depth + 1):
        new = seen.where(F.col("hops") == h - 1).join(und, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(h))
        seen = materialize(seen.unionByName(new), "seen")
    return seen if include_start else seen.where("hops > 0")


def subgraph(vertices: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = ids.select("id").distinct()
    return vertices.join(k, "id", "left_semi"), edges.join(k.withColumnRenamed("id", "src"), "src", "left_semi").join(k.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def node_metrics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees, neighbours, summed risk of neighbours and clustering coefficient of every vertex.

    Triangles are counted from edges oriented towards the end of higher degree, so a
    vertex of any degree is expanded over few pairs.
    """
    und = materialize(undirected(edges), "und")
    deg = und.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("neighbour_count"))
    lo, hi = F.struct(F.col("ds"), F.col("src")), F.struct(F.col("dd"), F.col("dst"))
    o = und.join(deg.select(F.col("id").alias("src"), F.col("neighbour_count").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("neighbour_count").alias("dd")), "dst").where(lo < hi).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    wedge = o.join(o.select("a", F.col("b").alias("c")), "a").where("b < c")
    tri = wedge.join(und.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"]).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    exposure = und.join(vertices.select(F.col("id").alias("dst"), "risk_score"), "dst", "left").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("risk_score").cast("decimal(28,12)")).cast("double").alias("exposure"))  # decimals add up to the same in any order
    out = vertices.select("id").join(degrees(edges), "id", "left").join(deg, "id", "left").join(tri, "id", "left").join(exposure, "id", "left").na.fill(0)
    n = F.col("neighbour_count")
    coeff = F.coalesce(ratio(F.col("links") * 2, n * (n - 1)), F.lit(0.0))
    return out.select("id", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("total_degree"), "neighbour_count", F.col("exposure").alias("risk_exposure"), coeff.alias("clustering_coefficient"))


def type_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(dimension, member, row_count)``: nodes by type and edges by relationship type."""
    v = vertices.groupBy(F.col("entity_type").alias("member")).agg(F.count("*").alias("row_count"))
    e = edges.groupBy(F.col("relationship_type").alias("member")).agg(F.count("*").alias("row_count"))
    return v.select(F.lit("node_type").alias("dimension"), "*").unionByName(e.select(F.lit("relationship_type").alias("dimension"), "*"))


def summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: numbers of nodes and edges, mean risk, nodes of risk 0.7 or more."""
    v = vertices.agg(F.count("*").alias("nodes"), F.avg("risk_score").alias("avg_risk"), F.count_if(F.col("risk_score") >= 0.7).alias("high_risk_nodes"))
    return v.crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


def edge_id(src: str, dst: str, kind: str) -> F.Column:
    return F.substring(F.md5(F.concat_ws("_", F.col(src).cast("string"), F.col(dst).cast("string"), F.col(kind))), 1, 16)


def relationships_from_transactions(edges: DataFrame) -> DataFrame:
    """SENT_TO edges; of payments between the same two entities the latest stays."""
    last = edges.groupBy("src", "dst").agg(F.max_by(F.struct("id", "amount"), F.struct("ts", "id")).alias("m"))
    return last.select("src", "dst", F.lit("SENT_TO").alias("relationship_type"), F.col("m.amount").alias("weight"), F.col("m.id").alias("transaction_id")).withColumn("edge_id", edge_id("src", "dst", "relationship_type"))


def relationships_from_companies(records: DataFrame) -> DataFrame:
    """DIRECTOR_OF, SHAREHOLDER_OF (CONTROLS above 50 percent) and BENEFICIAL_OWNER edges of nested company records."""
    d = records.select(F.explode("directors").alias("x"), "company_id").select(F.col("x.entity_id").alias("src"), F.col("company_id").alias("dst"), F.lit("DIRECTOR_OF").alias("relationship_type"), F.lit(1.0).alias("weight"))
    s = records.select(F.explode("shareholders").alias("x"), "company_id").select(F.col("x.entity_id").alias("src"), F.col("company_id").alias("dst"), F.when(F.col("x.percentage") > 50, "CONTROLS").otherwise("SHAREHOLDER_OF").alias("relationship_type"), (F.col("x.percentage") / 100).alias("weight"))
    b = records.select(F.explode("beneficial_owners").alias("x"), "company_id").select(F.col("x.entity_id").alias("src"), F.col("company_id").alias("dst"), F.lit("BENEFICIAL_OWNER").alias("relationship_type"), (F.col("x.percentage") / 100).alias("weight"))
    return d.unionByName(s).unionByName(b).withColumn("edge_id", edge_id("src", "dst", "relationship_type"))


SHARED = (("address", "CO_LOCATED", 0.7), ("phone", "SHARES_PHONE", 0.8), ("email", "SHARES_EMAIL", 0.8))


def shared_attributes(nodes: DataFrame, rules: tuple[tuple[str, str, float], ...] = SHARED) -> DataFrame:
    """Inferred edges between nodes ``(id, ord, attributes)`` with the same non-empty attribute, in order of ``ord``."""
    out = None
    for name, kind, confidence in rules:
        v = nodes.select("id", "ord", F.element_at("attributes", name).alias("v")).where("v <> ''")
        b = v.select(F.col("id").alias("dst"), F.col("ord").alias("ord2"), "v")
        e = v.join(b, "v").where("ord < ord2").select(F.col("id").alias("src"), "dst", F.lit(kind).alias("relationship_type"), F.lit(confidence).alias("confidence"), F.concat_ws("_", F.lit("inferred"), "id", "dst", F.lit(name)).alias("edge_id"))
        out = e if out is None else out.unionByName(e)
    return out


def shared_classes(nodes: DataFrame, rules: tuple[tuple[str, str, float], ...] = SHARED) -> DataFrame:
    """``(relationship_type, value, root, members, links)``: nodes with one attribute value as a class, in place of all its pairs.

    ``root`` is the first node, ``links`` how many pairs the class stands for; with the
    attribute of each node this says which are linked, however many share one address.
    """
    parts = [F.struct(F.lit(kind).alias("relationship_type"), F.element_at("attributes", name).alias("value")) for name, kind, _ in rules]
    v = nodes.select("id", "ord", F.inline(F.array(*parts))).where("value <> ''")
    g = v.groupBy("relationship_type", "value").agg(F.min_by("id", "ord").alias("root"), F.count("*").alias("members")).where("members > 1")
    return g.withColumn("links", F.expr("members * (members - 1) div 2"))


def frequent_pairs(edges: DataFrame, min_count: int = 3) -> DataFrame:
    """TRANSACTED_WITH edges of unordered pairs with enough payments; confidence grows with their number."""
    g = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").alias("n"), F.sum("amount").alias("total_amount"))
    return g.where(F.col("n") >= min_count).select("src", "dst", F.lit("TRANSACTED_WITH").alias("relationship_type"), F.col("n").cast("double").alias("weight"), F.least(F.lit(1.0), 0.85 + 0.02 * F.col("n")).alias("confidence"), "total_amount")


def add_inferred(edges: DataFrame, inferred: DataFrame) -> DataFrame:
    """Inferred edges whose id is not there yet, added."""
    return edges.unionByName(inferred.join(edges.select("edge_id"), "edge_id", "left_anti"), allowMissingColumns=True)


# Relationship types that are known; others count as RELATED_TO.
RELATIONSHIPS = (
    "OWNS", "CONTROLS", "DIRECTOR_OF", "SHAREHOLDER_OF", "EMPLOYEE_OF", "RELATED_TO", "FAMILY_OF", "TRANSACTED_WITH", "SENT_TO", "RECEIVED_FROM", "ACCOUNT_HOLDER", "AUTHORIZED_SIGNATORY", "BENEFICIAL_OWNER",
    "REGISTERED_AT", "RESIDES_AT", "OPERATES_FROM", "CONTACTED", "SHARES_PHONE", "SHARES_EMAIL", "SHARES_DEVICE", "CO_LOCATED",
)
Inference = Callable[[DataFrame, DataFrame], DataFrame]


def make_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of ``(id, ord, entity_type, name, attributes, risk_score)``: of rows that repeat an id the last stays; no risk counts as 0."""
    last = rows.groupBy("id").agg(F.max_by(F.struct("entity_type", "name", "attributes", "risk_score"), "ord").alias("n"), F.min("ord").alias("ord"))
    return last.select("id", "ord", "n.entity_type", "n.name", "n.attributes", F.coalesce("n.risk_score", F.lit(0.0)).alias("risk_score"))


def make_edges(rows: DataFrame) -> DataFrame:
    """Edges of ``(src, dst, ord, relationship_type)``, weight and confidence 1 unless given; of rows that repeat an id the last stays."""
    kind = F.when(F.col("relationship_type").isin(*RELATIONSHIPS), F.col("relationship_type")).otherwise("RELATED_TO")
    one = lambda c: (F.coalesce(c, F.lit(1.0)) if c in rows.columns else F.lit(1.0)).alias(c)
    e = rows.select("src", "dst", "ord", kind.alias("relationship_type"), one("weight"), one("confidence")).withColumn("edge_id", edge_id("src", "dst", "relationship_type"))
    last = e.groupBy("edge_id").agg(F.max_by(F.struct("src", "dst", "relationship_type", "weight", "confidence"), "ord").alias("e"))
    return last.select("e.*", "edge_id")


def infer_shared(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return shared_attributes(nodes).withColumn("weight", F.lit(1.0))


def generate_network(nodes: DataFrame, edges: DataFrame, payments: DataFrame | None = None, rules: Sequence[Inference] = (infer_shared,)) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a network: explicit edges, payments (the last of each pair as SENT_TO), and what the rules infer.

    A rule is a function of nodes and edges; rules run in order, and an inferred edge is
    added only if its id is new. With payments, pairs that pay each other often are linked
    last.
    """
    cols = ["src", "dst", "relationship_type", "weight", "confidence", "edge_id"]
    v = materialize(make_nodes(nodes), "nodes")
    e = make_edges(edges).select(cols)
    if payments is not None:
        sent = relationships_from_transactions(payments).withColumn("confidence", F.lit(1.0)).select(cols)
        e = e.join(sent.select("edge_id"), "edge_id", "left_anti").select(cols).unionByName(sent)
    for rule in rules:
        e = add_inferred(e, rule(v, e).select(cols))
    if payments is not None:
        often = frequent_pairs(payments)
        often = often.withColumn("edge_id", F.concat_ws("_", F.lit("tx_pattern"), "src", "dst")).select(cols)
        e = add_inferred(e, often)
    return v, materialize(e, "edges")


def match_pattern(vertices: DataFrame, edges: DataFrame, relationship: str | None = None, source_type: str | None = None, target_type: str | None = None) -> DataFrame:
    """``(source_id, source_name, relationship_type, target_id, target_name)`` of edges that fit types given or not."""
    e = edges.where(F.col("relationship_type") == relationship) if relationship else edges
    side = lambda p, kind: (vertices.where(F.col("entity_type") == kind) if kind else vertices).select(F.col("id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"))
    s, t = side("source", source_type), side("target", target_type)
    return e.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "relationship_type").join(s, "source_id").join(t, "target_id")


def create_relationships(vertices: DataFrame, edges: DataFrame, rows: DataFrame) -> DataFrame:
    """``edges`` with those of ``rows`` added whose two ends exist."""
    ids = vertices.select("id").distinct()
    known = rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.unionByName(known, allowMissingColumns=True)


def export_records(vertices: DataFrame) -> DataFrame:
    """Node records with an upper-case label and flattened properties; attribute keys win."""
    base = F.create_map(F.lit("name"), F.col("name"), F.lit("risk_score"), F.col("risk_score").cast("string"))
    attrs = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    props = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(attrs, k)), attrs)
    return vertices.select("id", F.upper("entity_type").alias("label"), props.alias("properties"))


def transaction_flow(edges: DataFrame, entity: object, direction: str = "both", limit: int = 50) -> DataFrame:
    """The newest payments of an entity, in, out or both."""
    cond = {"in": F.col("dst") == entity, "out": F.col("src") == entity, "both": (F.col("src") == entity) | (F.col("dst") == entity)}[direction]
    return edges.where(cond).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def pagerank(vertices: DataFrame, edges: DataFrame, reset: float = 0.15, rounds: int = 20) -> DataFrame:
    """Fixed rounds from rank 1, highest first; parallel edges count; ranks are rescaled to sum to the number of vertices."""
    out = materialize(edges.groupBy("src", "dst").agg(F.count("*").alias("w")), "links")
    total = out.groupBy("src").agg(F.sum("w").alias("d"))
    links = materialize(out.join(total, "src").select("src", "dst", (F.col("w") / F.col("d")).alias("share")), "shares")
    ids = materialize(vertices.select("id").distinct(), "ids")
    ranks = ids.withColumn("rank", F.lit(1.0))
    for i in range(rounds):
        got = links.join(ranks, links["src"] == ranks["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = ids.join(got, "id", "left").select("id", (F.lit(reset) + (1 - reset) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        ranks = materialize(new, "ranks") if i % 3 == 2 or i == rounds - 1 else new
    n = ranks.agg(F.count("*").alias("n"), F.sum("rank").alias("s"))
    return ranks.crossJoin(F.broadcast(n)).select("id", (F.col("rank") * F.col("n") / F.col("s")).alias("pagerank")).orderBy(F.desc("pagerank"), "id")  # n is one row


def label_propagation(vertices: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``(id, label)``: each round the commonest label of the neighbours, the smallest of equals."""
    both = materialize(edges.select("src", "dst").union(edges.select("dst", "src")).toDF("src", "dst").groupBy("src", "dst").agg(F.count("*").alias("w")), "both")
    labels = materialize(vertices.select("id", F.col("id").alias("label")), "labels")
    for _ in range(rounds):
        votes = both.join(labels, both["src"] == labels["id"]).groupBy("dst", "label").agg(F.sum("w").alias("n"))
        best = votes.groupBy(F.col("dst").alias("id")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("new"))
        nxt = materialize(labels.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label")), "labels")
        release(labels)
        labels = nxt
    return labels


def community_stats(vertices: DataFrame, labels: DataFrame, min_size: int = 1) -> DataFrame:
    g = vertices.join(labels, "id").groupBy("label").agg(F.count("*").alias("size"), F.avg("risk_score").alias("avg_risk"), F.sum("is_sanctioned").alias("sanctioned"), F.sum("is_pep").alias("peps"))
    a = F.col("avg_risk")
    risk = F.when(F.col("sanctioned") > 0, 0.9).when(F.col("peps") > 0, 0.7).when(a >= 0.5, 0.6).otherwise(a)
    return g.where(F.col("size") >= min_size).withColumn("community_risk", risk).orderBy(F.desc("community_risk"), "label")


def louvain(vertices: DataFrame, edges: DataFrame, levels: int = 6, rounds: int = 8) -> DataFrame:
    """``(id, label)``: communities by greedy modularity, level by level.

    In each round half of the nodes, chosen by hash, may move to the neighbouring community
    of greatest gain (of equal ones the least, and only for a gain), so that two nodes seldom
    swap places; after some rounds communities become the nodes of the next level. Parallel
    edges add up, directions do not count; a label is the least id of its community.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = materialize(both.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")), "louvain-links")
    labels = materialize(vertices.select("id", F.col("id").alias("label")).distinct(), "louvain-labels")
    m2 = links.agg(F.sum("w")).first()[0] or 0.0
    for level in range(levels if m2 else 0):
        degree = materialize(links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "louvain-degree")
        part = materialize(degree.select("id", F.col("id").alias("c"), "k"), "louvain-part")
        any_moved = False
        for r in range(rounds):
            total = part.groupBy("c").agg(F.sum("k").alias("t"))
            near = links.where("src <> dst").join(part.select(F.col("id").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("w"))
            turn = part.where(F.pmod(F.xxhash64("id", F.lit(level * rounds + r)), F.lit(2)) == 0).select("id", F.col("c").alias("own"), "k")
            seen = turn.join(near, "id").join(total, "c")
            gain = F.col("w") - F.col("k") * (F.col("t") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / m2
            g = seen.withColumn("gain", F.round(gain, 9)).groupBy("id", "own").agg(F.max(F.struct("gain", (-F.col("c")).alias("o"), "c")).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("now"), F.first("k").alias("k"))
            alone = F.coalesce("now", F.lit(0.0))
            moves = materialize(g.where((F.col("best.c") != F.col("own")) & (F.col("best.gain") > alone)).select("id", F.col("best.c").alias("to")), "louvain-moves")
            if moves.isEmpty() and r:
                break
            any_moved = any_moved or not moves.isEmpty()
            nxt = materialize(part.join(moves, "id", "left").select("id", F.coalesce("to", "c").alias("c"), "k"), "louvain-part")
            release(part)
            part = nxt
        if not any_moved:
            break
        least = part.groupBy("c").agg(F.min("id").alias("least"))
        named = materialize(part.join(least, "c").select("id", F.col("least").alias("c")), "louvain-named")
        labels = materialize(labels.join(named, labels["label"] == named["id"], "left").select(labels["id"], F.coalesce("c", "label").alias("label")), "louvain-labels")
        a, b = (named.select(F.col("id").alias(x), F.col("c").alias(f"c_{x}")) for x in ("src", "dst"))
        links = materialize(links.join(a, "src").join(b, "dst").groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("w").alias("w")), "louvain-links")
    return labels


def modularity(labels: DataFrame, edges: DataFrame) -> float:
    """Of a division into communities, over undirected edges with their multiplicity."""
    l = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}"))
    e = edges.select("src", "dst").join(l("src"), "src").join(l("dst"), "dst")
    inside, m = e.agg(F.count_if(F.col("l_src") == F.col("l_dst")), F.count("*")).first()
    ends = e.select(F.explode(F.array("l_src", "l_dst")).alias("label")).groupBy("label").agg(F.count("*").alias("k"))
    return inside / m - (ends.agg(F.sum(F.col("k") * F.col("k"))).first()[0] / (4 * m * m))


def communities(vertices: DataFrame, edges: DataFrame, min_size: int = 3, limit: int = 20) -> DataFrame:
    """``(community, size, members)`` of the largest Louvain communities; members are gathered of the chosen ones only."""
    labels = louvain(vertices, edges)
    chosen = labels.groupBy(F.col("label").alias("community")).agg(F.count("*").alias("size")).where(F.col("size") >= min_size).orderBy(F.desc("size"), "community").limit(limit)
    members = labels.join(F.broadcast(chosen), F.col("label") == F.col("community"))  # at most ``limit`` rows
    return members.groupBy("community", "size").agg(F.array_sort(F.collect_list("id")).alias("members")).orderBy(F.desc("size"), "community")


def propagate_risk(vertices: DataFrame, edges: DataFrame, source: object, max_hops: int = 3, decay: float = 0.5) -> DataFrame:
    """``(id, hops, risk)`` from one vertex; ``edges`` have ord, confidence and weight.

    A vertex takes the source's risk times decay^hops, confidence and weight of the edge
    of least ord that reaches it from the level before.
    """
    risk = vertices.where(F.col("id") == source).select(F.col("id"), F.lit(0).alias("hops"), F.col("risk_score").alias("risk"))
    e = edges.select("src", "dst", "ord", "confidence", "weight")
    both = materialize(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ord", "confidence", "weight")), "both")
    base, seen = risk.select(F.col("risk").alias("base")), materialize(risk, "risk")
    for h in range(1, max_hops + 1):
        step = seen.where(F.col("hops") == h - 1).select(F.col("id").alias("src")).join(both, "src").join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        first = step.groupBy(F.col("dst").alias("id")).agg(F.min_by(F.struct("confidence", "weight"), "ord").alias("e")).crossJoin(F.broadcast(base))  # base is one row
        new = first.select("id", F.lit(h).alias("hops"), (F.col("base") * decay**h * F.col("e.confidence") * F.col("e.weight")).alias("risk"))
        seen = materialize(seen.unionByName(new), "risk")
    return seen


def trails(edges: DataFrame, source: object, depth: int = 2) -> DataFrame:
    """``(id, distance, relationship_type, path)``: every undirected path of up to ``depth`` edges, none used twice; ``edges`` have edge_id."""
    e = edges.select("src", "dst", "edge_id", "relationship_type")
    both = materialize(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_id", "relationship_type").where("src <> dst")), "both")
    now = both.where(F.col("src") == source).select(F.col("dst").alias("id"), F.lit(1).alias("distance"), "relationship_type", F.array("edge_id").alias("path"))
    out = now
    for d in range(2, depth + 1):
        now = now.select("id", "path").join(both, F.col("id") == F.col("src")).where(~F.array_contains("path", F.col("edge_id"))).select(F.col("dst").alias("id"), F.lit(d).alias("distance"), "relationship_type", F.array_append("path", F.col("edge_id")).alias("path"))
        out = out.unionByName(now)
    return out


def entity_relationships(edges: DataFrame, source: object, depth: int = 2, limit: int = 100) -> DataFrame:
    return trails(edges, source, depth).orderBy("distance", "id", "path").limit(limit)


def path_risk(vertices: DataFrame, edges: DataFrame, source: object, depth: int = 3, limit: int = 50) -> DataFrame:
    """Per path: the source's risk divided by the distance, without the source, highest first."""
    base = vertices.where(F.col("id") == source).select(F.col("risk_score").alias("base"))
    t = trails(edges, source, depth).where(F.col("id") != source).crossJoin(F.broadcast(base))  # base is one row
    return t.select("id", "distance", (F.col("base") / F.col("distance")).alias("propagated_risk"), "path").orderBy(F.desc("propagated_risk"), "id", "path").limit(limit)


def entity_network(vertices: DataFrame, edges: DataFrame, source: object, depth: int = 2, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` hops (at most ``limit``, nearest first) and the distinct edges between them (at most twice that)."""
    start = vertices.where(F.col("id") == source).select("id")
    near = neighbours(edges, start, depth, include_start=True).orderBy("hops", "id").limit(limit)
    v, e = subgraph(vertices, edges, near)
    return v, e.distinct().orderBy("src", "dst").limit(2 * limit)


def shortest_path(edges: DataFrame, source: object, target: object, max_depth: int = 10) -> DataFrame:
    """One row ``(length, path)``: a least undirected path (of equals the least by ids), or -1 and null."""
    spark = edges.sparkSession
    und = materialize(undirected(edges), "und")
    kind = und.schema["src"].dataType.simpleString()
    seen = materialize(spark.createDataFrame([(source, [source])], f"id {kind}, path array<{kind}>"), "bfs")
    front = seen
    for _ in range(max_depth):
        hit = seen.where(F.col("id") == target)
        if not hit.isEmpty() or front.isEmpty():
            break
        step = front.join(und, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.array_append("path", F.col("dst")).alias("path"))
        front = materialize(step.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")), "front")
        seen = seen.unionByName(front)
    found = seen.where(F.col("id") == target).select((F.size("path") - 1).alias("length"), "path")
    none = spark.createDataFrame([(-1, None)], f"length int, path array<{kind}>")
    return found.unionByName(none).orderBy(F.desc("length")).limit(1)


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Betweenness summed over shortest paths from ``sources`` (all vertices for the exact values); see ``paths.sampled_betweenness`` for large graphs."""
    parts = betweenness_parts(materialize(undirected(edges), "und"), sources)
    return parts.groupBy(F.col("v").alias("id")).agg((F.sum("delta") / 2).alias("betweenness"))


def betweenness_parts(und: DataFrame, sources: DataFrame) -> DataFrame:
    """``(s, v, delta)``: how much the shortest paths from each source depend on each other vertex, by Brandes' recurrences."""
    level = sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("sigma"))
    seen = materialize(level, "paths")
    for d in itertools.count(1):
        step = seen.where(F.col("d") == d - 1).join(und, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
        new = materialize(step.join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(d).alias("d"), "sigma"), "paths")
        if new.isEmpty():
            break
        seen = materialize(seen.unionByName(new), "paths")
    most = seen.agg(F.max("d")).first()[0] or 0
    delta = seen.where(F.col("d") == most).select("s", "v", F.lit(0.0).alias("delta"))
    out = delta
    for d in range(most, 0, -1):
        w = seen.where(F.col("d") == d).join(delta, ["s", "v"]).select("s", F.col("v").alias("dst"), F.col("sigma").alias("sw"), "delta")
        up = seen.where(F.col("d") == d - 1).join(und, F.col("v") == F.col("src")).join(w, ["s", "dst"]).groupBy("s", "v").agg(F.sum(F.col("sigma") / F.col("sw") * (1 + F.col("delta"))).alias("delta"))
        delta = materialize(seen.where(F.col("d") == d - 1).join(up, ["s", "v"], "left").select("s", "v", F.coalesce("delta", F.lit(0.0)).alias("delta")), "delta")
        out = out.unionByName(delta)
    return out.where("s <> v")


def centrality(vertices: DataFrame, edges: DataFrame, algorithm: str = "degree", limit: int = 20) -> DataFrame:
    """Top entities by 'pagerank', 'betweenness' or 'degree' (also for unknown names)."""
    if algorithm == "pagerank":
        s = pagerank(vertices, edges).withColumnRenamed("pagerank", "score")
    elif algorithm == "betweenness":
        s = betweenness(edges, vertices.select("id")).withColumnRenamed("betweenness", "score")
    else:
        s = degrees(edges).select("id", (F.col("in_degree") + F.col("out_degree")).cast("double").alias("score"))
    return s.orderBy(F.desc("score"), "id").limit(limit)


def risk_level(score: F.Column) -> F.Column:
    return ladder(score, [(0.8, "critical"), (0.6, "high"), (0.4, "medium")], "low")
