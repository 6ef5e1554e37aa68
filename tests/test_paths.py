"""Searches on graphs and pages by key against plain versions."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from sentrail.functions import segments
from sentrail.operators import analytics, network, paths, vectors, workflow
from sentrail.session import scratch


def graph(seed, n, m, parts=1):
    """Random pairs of vertices, with loops, repeats and, with more parts, no edge between some."""
    rng = random.Random(seed)
    return [(v, parts * rng.randrange(n // parts) + v % parts) for v in (rng.randrange(n) for _ in range(m))]


def plain_paths(edges, source, target, most):
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    best, seen = [[source]], {source}
    for d in range(most + 1):
        found = sorted(p for p in best if p[-1] == target)
        if found:
            return d, found[0]
        best = sorted(p + [v] for p in best for v in near[p[-1]] if v not in seen)
        level = {p[-1]: None for p in best}
        best = [next(p for p in best if p[-1] == v) for v in level]
        seen |= set(level)
    return -1, None


@pytest.mark.parametrize("seed,n,m,parts", [(2, 60, 55, 2), (3, 12, 60, 1)])
def test_shortest_paths_equal_plain(spark, seed, n, m, parts):
    edges = graph(seed, n, m, parts)
    pairs = [(a, b) for a, b in itertools.product(range(0, n, 5), range(0, n, 3))] + [(1, 1), (None, 2), (999, 1)]
    got = {tuple(r[:2]): tuple(r[2:]) for r in paths.shortest_paths(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(pairs, "source long, target long"), 6).collect()}
    assert got == {(a, b): plain_paths(edges, a, b, 6) if a is not None else (-1, None) for a, b in pairs}


def test_shortest_paths_along_a_chain(spark):
    edges = spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    ask = lambda most: paths.shortest_paths(edges, spark.createDataFrame([(0, 11), (5, 30)], "source long, target long"), most).collect()
    assert {r["target"]: r["length"] for r in ask(11)} == {11: 11, 30: -1}
    assert {r["target"]: r["path"] for r in ask(11)}[11] == list(range(12))


NODES = [(i, i, {k: v for k, v in (("address", a), ("phone", p)) if v}) for i, a, p in [(1, "A", None), (2, "A", "P"), (3, None, "P"), (4, "B", None), (5, "B", "Q"), (6, "A", "Q"), (7, "", None), (8, None, None), (9, "C", None)]]


def small(spark):
    nodes = spark.createDataFrame(NODES, "id long, ord long, attributes map<string,string>").withColumn("risk_score", F.lit(0.8))
    edges = spark.createDataFrame([(3, 9, 1, 0.9, 0.5), (8, 5, 2, 1.0, 0.7), (1, 2, 3, 0.4, 0.3)], "src long, dst long, ord long, confidence double, weight double")
    return nodes, edges


def test_hops_through_stars_equal_those_over_pairs(spark):
    nodes, edges = small(spark)
    pairs = network.shared_attributes(nodes)
    every = edges.select("src", "dst").unionByName(pairs.select("src", "dst"))
    stars = paths.attribute_stars(nodes)
    for start, depth in ((1, 1), (3, 3), (7, 2), (8, 2)):
        one = nodes.where(F.col("id") == start)
        want = {tuple(r) for r in network.neighbours(every, one, depth).collect()}
        assert {tuple(r) for r in paths.neighbours_through(edges, stars, one, depth).collect()} == want
    assert stars.count() == 9  # members, not pairs


def test_propagation_through_stars_equals_that_over_pairs(spark):
    nodes, edges = small(spark)
    order = {kind: i for i, (_, kind, _) in enumerate(network.SHARED)}
    inferred = network.shared_attributes(nodes).collect()
    rows = [tuple(r) for r in edges.collect()] + [(r["src"], r["dst"], 1000 + 100 * order[r["relationship_type"]], r["confidence"], 1.0) for r in inferred]
    every = spark.createDataFrame(rows, "src long, dst long, ord long, confidence double, weight double")
    stars = paths.attribute_stars(nodes)
    for source in (3, 8):
        near = lambda df: {r["id"]: (r["hops"], round(r["risk"], 12)) for r in df.collect()}
        assert near(paths.propagate_through(nodes, edges, stars, source, 3)) == near(network.propagate_risk(nodes, every, source, 3))


def test_network_with_stars(spark):
    nodes, edges = small(spark)
    rows = nodes.withColumns({"entity_type": F.lit("person"), "name": F.lit("n")})
    v, e, stars = paths.network_with_stars(rows, edges.withColumn("relationship_type", F.lit("OWNS")))
    assert v.count() == 9 and e.count() == 3 and {r["relationship_type"] for r in stars.collect()} == {"CO_LOCATED", "SHARES_PHONE"}
    full = network.generate_network(rows, edges.withColumn("relationship_type", F.lit("OWNS")))[1]
    counts = {r["relationship_type"]: r["count"] for r in full.groupBy("relationship_type").count().collect()}
    assert {r["relationship_type"]: r["links"] for r in paths.star_links(stars).collect()} == {k: n for k, n in counts.items() if k != "OWNS"}


def exact_betweenness(edges, n):
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out = collections.Counter()
    for s in range(n):
        sigma, dist, order = collections.Counter({s: 1}), {s: 0}, [s]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = collections.Counter()
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
        for v in order:
            if v != s:
                out[v] += delta[v] / 2
    return out


def test_sampled_betweenness_of_all_sources_is_exact(spark):
    edges = graph(4, 30, 45)
    got = paths.sampled_betweenness(spark.range(30), spark.createDataFrame(edges, "src long, dst long"), epsilon=0.001, batch=16).collect()
    want = exact_betweenness(edges, 30)
    assert len(got) == 30 and all(abs(r["betweenness"] - want[r["id"]]) < 1e-6 and r["error"] == 0 and r["sources"] == 30 for r in got)


def test_sampled_betweenness_is_within_its_bound(spark):
    n = 300
    edges = graph(5, n, 420)
    got = paths.sampled_betweenness(spark.range(n), spark.createDataFrame(edges, "src long, dst long"), epsilon=0.25, batch=64).collect()
    want = exact_betweenness(edges, n)
    assert 64 <= got[0]["sources"] < n and max(r["error"] for r in got) <= 0.25
    assert all(abs(r["betweenness"] - want[r["id"]]) / (n * (n - 2) / 2) <= r["error"] for r in got)
    assert paths.sampled_betweenness(spark.range(0), spark.createDataFrame([], "src long, dst long")).count() == 0


def test_betweenness_in_many_blocks_with_hubs(spark, monkeypatch):
    """Exact in many blocks and with sources in several parts; the edges of a hub are spread over the blocks."""
    monkeypatch.setattr(vectors, "SUMS", 4096)
    monkeypatch.setattr(paths, "WIDTH", 16)
    n = 40
    edges = [(h, v) for h in (0, 1) for v in range(2, 32) if (v * 7 + h) % 5] + [(v, v + 1) for v in range(30, 36)] + [(37, 38)]
    v, e = spark.range(n), spark.createDataFrame(edges, "src long, dst long")
    got = paths.sampled_betweenness(v, e, epsilon=0.001).collect()
    want = exact_betweenness(edges, n)
    assert len(got) == n and all(abs(r["betweenness"] - want[r["id"]]) < 1e-6 and r["sources"] == n for r in got)
    with scratch():
        _, graph, blocks = vectors.in_blocks(network.undirected(e), v, 256)
        sizes = [len(r["b"]) // 4 for r in graph.select("b").collect()]
    assert len(sizes) == blocks >= 4 and sum(sizes) == len(edges) and max(sizes) < len(edges) / 2


# pages -------------------------------------------------------------------------


@pytest.mark.parametrize("down,first", [(False, False), (False, True), (True, False), (True, True)])
def test_pages_by_key_equal_offsets(spark, down, first):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, 1.0, 2.0, 3.0]), rng.choice([None, "a", "b"])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v double, s string")
    order = [("v", down, first), ("s", not down, first), ("id", False, True)]
    every = [tuple(r) for r in df.orderBy(*analytics.sorted_by(order)).collect()]
    after, pages = None, []
    while True:
        page = [r.asDict() for r in analytics.page_after(df, order, after, 7).collect()]
        if not page:
            break
        pages += [(r["id"], r["v"], r["s"]) for r in page]
        after = page[-1]
    assert pages == every
    starts = {r["page"]: r.asDict() for r in analytics.page_starts(df, order, 7).collect()}
    assert sorted(starts) == list(range(2, 10))
    assert [r["id"] for r in analytics.page_after(df, order, starts[5], 7).collect()] == [r[0] for r in every[28:35]]


def test_a_key_is_filtered_where_rows_are_read(spark, tmp_path):
    spark.range(1000).withColumn("v", F.col("id") % 50).write.parquet(str(tmp_path / "t"))
    page = analytics.page_after(spark.read.parquet(str(tmp_path / "t")), [("v", True, True), ("id", False, True)], {"v": 7, "id": 3}, 5)
    plan = page._jdf.queryExecution().toString()
    assert "LessThanOrEqual(v,7)" in plan and "TakeOrderedAndProject" in plan and "Offset" not in plan


def test_numbers_over_the_whole_table(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = segments.numbered(spark.range(500).select((F.col("id") * 7919 % 500).alias("x")), ["x"], "n").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 500 and all(r["n"] == r["x"] + 1 for r in got)


# the first paths in order ----------------------------------------------------------


def multigraph(spark, seed, n, m):
    rng = random.Random(seed)
    rows = [(rng.randrange(n), rng.randrange(n), f"e{i:03}", "SENT_TO") for i in range(m)]
    return spark.createDataFrame(rows, "src long, dst long, edge_id string, relationship_type string")


@pytest.mark.parametrize("seed,n,m,cap", [(2, 5, 14, 3)])
def test_first_trails_equal_all_trails(spark, seed, n, m, cap):
    e = multigraph(spark, seed, n, m)
    for depth, limit in ((1, 3), (3, 25), (3, 5000)):
        want = [tuple(r) for r in network.trails(e, 0, depth).orderBy("distance", "id", "path").limit(limit).collect()]
        assert [tuple(r) for r in paths.first_trails(e, 0, depth, limit, cap).collect()] == want
    counts = {r["distance"]: r["count"] for r in network.trails(e, 0, 3).groupBy("distance").count().collect()}
    assert {r["distance"]: r["paths"] for r in paths.trail_counts(e, 0, 3).collect() if r["paths"]} == counts


def test_first_trails_of_a_hub(spark):
    """Ten thousand edges at one vertex have some 10^11 trails of three edges; a hundred are looked for."""
    hub = spark.range(10_000).select(F.lit(0).cast("long").alias("src"), (F.col("id") + 1).alias("dst"), F.format_string("e%05d", "id").alias("edge_id"), F.lit("SENT_TO").alias("relationship_type"))
    chain = spark.createDataFrame([(-1, 0, "a", "SENT_TO"), (5, 7, "b", "SENT_TO")], hub.schema)
    got = paths.first_trails(hub.unionByName(chain), -1, 3, 100).collect()
    assert [(r["id"], r["distance"]) for r in got] == [(0, 1), *[(i, 2) for i in range(1, 100)]]
    got = paths.first_trails(hub.unionByName(chain), -1, 3, 10_010).collect()
    assert [(r["id"], r["path"]) for r in got if r["distance"] == 3] == [(5, ["a", "e00006", "b"]), (7, ["a", "e00004", "b"])]
    assert [r["paths"] for r in paths.trail_counts(hub.unionByName(chain), -1, 3).orderBy("distance").collect()] == [1, 10_000, 2]


def test_ranked_path_risk(spark):
    e = multigraph(spark, 6, 6, 14)
    for risk in (0.9, 0.0):
        v = spark.createDataFrame([(i, risk) for i in range(6)], "id long, risk_score double")
        for limit in (4,):
            want = [tuple(r) for r in network.path_risk(v, e, 2, 3, limit).collect()]
            assert [tuple(r) for r in paths.ranked_path_risk(v, e, 2, 3, limit).collect()] == want


def test_exposure_is_the_same_in_any_order(spark):
    """200 neighbours of risk 0.1: 20, which is not above 20; doubles miss it by the order in which they are added."""
    v = spark.range(201).select("id", F.lit(0.1).alias("risk_score"))
    e = spark.range(1, 201).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    m = network.node_metrics(v, e)
    assert m.where("id = 0").first()["risk_exposure"] == 20.0 and workflow.exposure_alerts(m, 20).count() == 0
