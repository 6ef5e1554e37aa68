"""Queries of ranked search, joins by edit similarity, searches on the graph, pages by key, sinks and what follows from scores, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import customer360, network, paths, ranking, resolution, scoring, screening, workflow
from ..session import materialize, owned, shared_dir
from ..sources import tables as S
from ..streaming import sinks
from .derived import SYSTEMS, records
from .lists import DOCS_SQL, PG, TRAILS, described, payments_of, text_tokens
from .queries import AL, ED, ENT, JOB, PEOPLE, SQL, TX, UN, edges_of, name_records, pick, query, rounded

# ranked search ----------------------------------------------------------------

CLOSE = "levenshtein(w, term) <= CASE WHEN length(w) <= 2 THEN 0 WHEN length(w) <= 5 THEN 1 ELSE 2 END"


def bm25(view: str, fields: Sequence[tuple[str, float]], words: Sequence[str], fuzzy: bool = False, key: str = "id") -> str:
    """SQL of ``(id, relevance)``: BM25 by field, the best field of each row."""
    texts = " UNION ALL ".join(f"SELECT {key} AS id, '{f}' AS field, {text_tokens(f)} AS ws FROM {view}" for f, _ in fields)
    weight = f"CASE WHEN {CLOSE} THEN 1 - levenshtein(w, term) / least(length(w), length(term))::DOUBLE ELSE 0 END" if fuzzy else "(w = term)::INT::DOUBLE"
    boost = "CASE field " + " ".join(f"WHEN '{f}' THEN {b}::DOUBLE" for f, b in fields) + " END"
    return f"""(WITH x AS (SELECT id, field, ws, len(ws) AS length FROM ({texts}) WHERE len(ws) > 0), st AS (SELECT field, count(*) AS n, avg(length) AS mean FROM x GROUP BY 1),
p AS (SELECT id, field, length, term, count(*) AS tf FROM (SELECT id, field, length, unnest(ws) AS term FROM x) GROUP BY ALL), q AS (SELECT field, term, df, sum(wt) AS wt FROM (SELECT *, {weight} AS wt
  FROM (SELECT field, term, count(*) AS df FROM p GROUP BY ALL), (VALUES {', '.join(f"('{w}')" for w in words)}) v(w)) WHERE wt > 0 GROUP BY ALL)
SELECT id, round(max({boost} * s), 9) AS relevance FROM (SELECT id, field, sum(wt * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS s
  FROM p JOIN q USING (field, term) JOIN st USING (field) GROUP BY ALL) GROUP BY id)"""


ENTITY_FIELDS = (("name", 3.0), ("entity_type", 1.0), ("country", 1.0))


@query("se01_ranked_entities", f"SELECT id, name, risk_score, relevance FROM {bm25('ent', ENTITY_FIELDS, ('machinary', 'custommer', 'de'), True)} JOIN ent USING (id) WHERE risk_score BETWEEN 0.5 AND 1 ORDER BY risk_score DESC, relevance DESC, id LIMIT 20", ENT)
def _(spark, d):
    e = S.entities(spark, d)
    index = ranking.build_index(e, [f for f, _ in ENTITY_FIELDS])
    return ranking.ranked_entities(e, index, "Machinary custommer DE", min_risk=0.5, attributes=("entity_type", "country")).select("id", "name", "risk_score", "relevance")


@query("se02_ranked_transactions", f"SELECT id, relevance FROM {bm25('sx', (('description', 1), ('reference_number', 1)), ('kp', 'click', '41'))} ORDER BY relevance DESC, id LIMIT 20", TX, AL, DOCS_SQL)
def _(spark, d):
    t = described(spark, d)[0]
    fields = ("description", "reference_number")
    return ranking.best_rows(t, ranking.ranked(ranking.build_index(t, fields), "KP click 41", dict.fromkeys(fields, 1.0))).select("id", "relevance")


@query("se03_ranked_alerts", f"SELECT id, relevance FROM {bm25('sa', (('title', 2), ('description', 1)), ('rule5', 'cat1', 'high'))} JOIN sa USING (id) WHERE status = 'new' ORDER BY relevance DESC, id LIMIT 20", TX, AL, DOCS_SQL)
def _(spark, d):
    a = described(spark, d)[1]
    hits = ranking.ranked(ranking.build_index(a, ("title", "description")), "rule5 cat1 high", {"title": 2.0, "description": 1.0})
    return ranking.best_rows(a.where("status = 'new'"), hits).select("id", "relevance")


EVERY = (("entities", "ent", ("name", "entity_type", "country")), ("transactions", "sx", ("description", "reference_number")), ("alerts", "sa", ("title", "description", "severity", "status")))


@query("se04_ranked_all", " UNION ALL ".join(f"(SELECT '{name}' AS index, id::VARCHAR AS id, relevance FROM {bm25(view, [(f, 1) for f in fields], ('machinery', 'kp', 'rule5'))} t ORDER BY relevance DESC, t.id LIMIT 10)" for name, view, fields in EVERY), TX, AL, ENT, DOCS_SQL)
def _(spark, d):
    t, a = described(spark, d)
    rows = {"entities": S.entities(spark, d), "transactions": t, "alerts": a}
    return ranking.ranked_all({name: (ranking.build_index(rows[name], fields), fields) for name, _, fields in EVERY}, "machinery kp rule5")


@query("se07_ranked_documents", f"SELECT doc_id, relevance FROM (SELECT id AS doc_id, relevance FROM {bm25('documents', (('text', 1),), ('token', 'license', 'the'), key='doc_id')}) ORDER BY relevance DESC, doc_id LIMIT 50")
def _(spark, d):
    docs = S.parquet(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = ranking.ranked(ranking.build_index(docs, ("text",)), "token license the", {"text": 1.0})
    return hits.orderBy(F.desc("relevance"), "id").limit(50).withColumnRenamed("id", "doc_id")


@query("scr06_ranked_screen", f"SELECT id, name, relevance AS match_score FROM (SELECT *, max(relevance) OVER () AS best FROM {bm25('ent', (('name', 1),), ('customer', '000000097'), True)} JOIN ent USING (id) WHERE is_sanctioned = 1) WHERE relevance >= 0.8::DOUBLE * best ORDER BY relevance DESC, id LIMIT 10", ENT)
def _(spark, d):
    e = S.entities(spark, d)
    return ranking.screen_ranked(e, ranking.build_index(e, ("name",)), "customer 000000097").select("id", "name", "match_score")


# joins by edit similarity ------------------------------------------------------


@query("era01_job_links", """, bo AS (SELECT id_a AS id, id_b AS o, s FROM jp WHERE s >= 0.8 UNION ALL SELECT id_b, id_a, s FROM jp WHERE s >= 0.8)
SELECT id, class_id, links, avg_similarity FROM (SELECT sd.id, min(sd.id) OVER (PARTITION BY n) AS class_id, coalesce(c, 0) AS links, round(a, 6) AS avg_similarity FROM sd LEFT JOIN (SELECT id, count(*) AS c, avg(s) AS a FROM bo GROUP BY 1) USING (id))""", PEOPLE, JOB)
def _(spark, d):
    return rounded(resolution.job_links(name_records(spark, d)), 6, "avg_similarity")


# searches on the graph -----------------------------------------------------------


@query("gr22_shortest_paths", """, ps AS (SELECT k AS source, (k * 37 + 11) % 150 AS target FROM range(50) t(k)), two AS (SELECT source, target, min(a.dst) AS x FROM ps JOIN un a ON a.src = source JOIN un b ON b.src = a.dst AND b.dst = target GROUP BY ALL),
three AS (SELECT source, target, min((a.dst, b.dst)) AS xy FROM ps JOIN un a ON a.src = source JOIN un b ON b.src = a.dst JOIN un c ON c.src = b.dst AND c.dst = target GROUP BY ALL)
SELECT source::BIGINT AS source, target::BIGINT AS target, CASE WHEN source = target THEN 0 WHEN u.src IS NOT NULL THEN 1 WHEN x IS NOT NULL THEN 2 WHEN xy IS NOT NULL THEN 3 ELSE -1 END AS length,
CASE WHEN source = target THEN source::VARCHAR WHEN u.src IS NOT NULL THEN source || ',' || target WHEN x IS NOT NULL THEN source || ',' || x || ',' || target WHEN xy IS NOT NULL THEN source || ',' || xy[1] || ',' || xy[2] || ',' || target END AS path
FROM ps LEFT JOIN un u ON u.src = source AND u.dst = target LEFT JOIN two USING (source, target) LEFT JOIN three USING (source, target)""", UN)
def _(spark, d):
    pairs = spark.range(50).select(F.col("id").alias("source"), (F.col("id") * 37 + 11) % 150)
    found = paths.shortest_paths(edges_of(spark, d)[1], pairs.toDF("source", "target"), 3)
    return found.select("source", "target", "length", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


def starred(spark, d):
    """Entities that share an address in hundreds and a phone in pairs, and their payments."""
    v, e = payments_of(spark, d)
    attributes = F.create_map(F.lit("address"), F.floor(F.col("id") / 100).cast("string"), F.lit("phone"), F.floor(F.col("id") / 2).cast("string"))
    return v, e, paths.attribute_stars(v.select("id", attributes.alias("attributes")))


MATES = "mates AS (SELECT a.id AS src, b.id AS dst, k AS rule FROM ent a JOIN ent b ON a.id <> b.id JOIN (VALUES (0, 100), (1, 2)) t(k, m) ON a.id // m = b.id // m)"


@query("gr09_hops_through_attributes", "SELECT id, min(h) AS hops FROM (SELECT dst AS id, 1 AS h FROM hop WHERE src = 3 UNION ALL SELECT b.dst, 2 FROM hop a JOIN hop b ON a.dst = b.src WHERE a.src = 3) WHERE id <> 3 GROUP BY id", UN, ENT, MATES, "hop AS (SELECT src, dst FROM un UNION SELECT src, dst FROM mates)")
def _(spark, d):
    v, e, stars = starred(spark, d)
    return paths.neighbours_through(e, stars, v.where("id = 3"), 2)


@query("gr11_propagated_through_attributes", """SELECT id, hops, round((SELECT risk_score FROM ent WHERE id = 3) * pow(0.5, hops) * w, 6) AS risk FROM (SELECT 3::BIGINT AS id, 0 AS hops, 1.0::DOUBLE AS w UNION ALL SELECT dst, 1, arg_min(w, (late, ord)) FROM al_ WHERE src = 3 AND dst <> 3 GROUP BY dst
UNION ALL SELECT dst, 2, arg_min(w, (late, ord)) FROM al_ WHERE src IN (SELECT dst FROM al_ WHERE src = 3) AND src <> 3 AND dst <> 3 AND dst NOT IN (SELECT dst FROM al_ WHERE src = 3) GROUP BY dst)""",
       PG, ENT, MATES, "al_ AS (SELECT src, dst, 0 AS late, ord, weight AS w FROM bo UNION ALL SELECT src, dst, 1, rule, CASE rule WHEN 0 THEN 0.7 ELSE 0.8 END FROM mates)")
def _(spark, d):
    return rounded(paths.propagate_through(*starred(spark, d), 3, 2), 6, "risk")


@query("gr16_star_links", "SELECT relationship_type, sum(n * (n - 1) // 2)::BIGINT AS links FROM (SELECT t.k AS relationship_type, count(*) AS n FROM ent JOIN (VALUES ('CO_LOCATED', 100), ('SHARES_PHONE', 2)) t(k, m) ON true GROUP BY t.k, id // m) GROUP BY 1", ENT)
def _(spark, d):
    return paths.star_links(starred(spark, d)[2])


@query("gr20_first_trails", "SELECT id, distance, array_to_string(path, ',') AS path FROM tr ORDER BY distance, id, tr.path LIMIT 1000", PG, TRAILS)
def _(spark, d):
    found = paths.first_trails(payments_of(spark, d)[1], 3, 3, 1000)
    return found.select("id", "distance", F.array_join("path", ",").alias("path"))


@query("gr20_trail_counts", "SELECT distance, count(*) AS paths FROM (SELECT distance FROM tr UNION ALL SELECT 3 FROM bo a JOIN bo b ON a.dst = b.src AND a.edge_id <> b.edge_id JOIN bo c ON b.dst = c.src AND c.edge_id <> a.edge_id AND c.edge_id <> b.edge_id WHERE a.src = 3) GROUP BY 1", PG, TRAILS)
def _(spark, d):
    return paths.trail_counts(payments_of(spark, d)[1], 3, 3)


@query("gr25_ranked_path_risk", "SELECT id, distance, round((SELECT risk_score FROM ent WHERE id = 3) / distance, 6) AS propagated_risk FROM tr WHERE id <> 3 ORDER BY 3 DESC, id, path LIMIT 500", PG, TRAILS, ENT)
def _(spark, d):
    v, e = payments_of(spark, d)
    return rounded(paths.ranked_path_risk(v, e, 3, 3, 500).select("id", "distance", "propagated_risk"), 6, "propagated_risk")


@query("gr24_sampled_betweenness")
def _(spark, d):
    """No SQL: the sources are a sample; tests hold it against exact values and its bound."""
    v, e = edges_of(spark, d)
    active = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return rounded(paths.sampled_betweenness(v.join(active, "id", "left_semi"), e, 0.05), 6, "betweenness", "error")


# pages by key ----------------------------------------------------------------------

NEWEST = [("transaction_date", True, True), ("id", False, True)]


@query("srt02_page_after", "SELECT id, transaction_date FROM tx, (SELECT transaction_date AS t, id AS i FROM tx WHERE id = 4321) WHERE transaction_date < t OR transaction_date = t AND id > i ORDER BY transaction_date DESC, id LIMIT 50", TX)
def _(spark, d):
    t = S.transactions(spark, d).select("id", "transaction_date")
    return A.page_after(t, NEWEST, t.where("id = 4321").first().asDict(), 50)


@query("srt02_page_starts", "SELECT n // 500 + 1 AS page, transaction_date, id FROM (SELECT *, row_number() OVER (ORDER BY transaction_date DESC, id) AS n FROM tx) WHERE n % 500 = 0", TX)
def _(spark, d):
    return A.page_starts(S.transactions(spark, d), NEWEST, 500)


# sinks and sources -------------------------------------------------------------------


@query("snk03_merged_batches", "SELECT id, CASE WHEN id % 10 = 0 THEN name || ' (changed)' ELSE name END AS name FROM ent WHERE id % 7 <> 0", ENT)
def _(spark, d):
    """The entities, a batch that changes a tenth of them, the same batch again, and a removal, in a table in the shared folder."""
    e = S.entities(spark, d).select("id", "name")
    path = f"{shared_dir(spark)}/merged-{uuid.uuid4().hex}"
    changed = e.where("id % 10 = 0").withColumn("name", F.concat("name", F.lit(" (changed)")))
    for batch in (e, changed, changed):
        sinks.merge_batch(batch, path)
    sinks.remove_keys(e.where("id % 7 = 0"), path)
    return owned(spark.read.parquet(path), path).select("id", "name")


@query("snk04_onto_existing", "SELECT src, dst, count(*) AS n FROM (SELECT c_custkey AS src, c_custkey + 10 AS dst FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_custkey + 10 FROM customer) WHERE dst IN (SELECT c_custkey FROM customer) GROUP BY ALL")
def _(spark, d):
    """Half of the edges are there before; an edge that is made again is one more."""
    c = S.parquet(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    rows = c.select(F.col("id").alias("src"), (F.col("id") + 10).alias("dst"))
    known = rows.where("src % 2 = 0").join(c.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    return network.create_relationships(c, known, rows).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("src02_declared_transactions", "SELECT transaction_type, currency, count(*) AS n, round(sum(amount), 2) AS total FROM (SELECT *, 'USD' AS currency FROM tx) GROUP BY ALL", TX)
def _(spark, d):
    """Written as files of the declared schema and read with it."""
    t = S.transactions(spark, d).select(*[F.expr(f"cast({c.split()[0]} as {c.split()[1]})") for c in S.TRANSACTION_SCHEMA.split(", ")])
    back = S.read_transactions(spark, materialize(t, "declared")._sentrail_path)
    return back.groupBy("transaction_type", "currency").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@query("src01_declared_entities", "SELECT entity_type, count(*) AS n, count(DISTINCT id) AS ids, min(name) AS first_name FROM ent GROUP BY ALL", ENT)
def _(spark, d):
    e = S.entities(spark, d).select(F.col("id").cast("string").alias("id"), "name", "entity_type", F.lit("crm").alias("source_system"), F.to_json(F.struct("country")).alias("attributes"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"))
    back = S.read_entities(spark, materialize(e, "declared")._sentrail_path)
    return back.groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("name").alias("first_name"))


# lists, scores and what follows ---------------------------------------------------------


@query("scr11_listed_names", f"""SELECT id, string_agg(DISTINCT provider || ':' || list_type || ':' || score, ',' ORDER BY provider || ':' || list_type || ':' || score) AS found FROM (SELECT p_partkey AS id, lower(p_name) AS low FROM part)
JOIN (SELECT 'list' || (p_partkey % 3) AS provider, lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_name, ' ', 2)) AS b, {pick('p_partkey', ('sanctions', 'pep', 'adverse_media'))} AS list_type, p_size AS score FROM part WHERE p_partkey % 40 = 0) ON contains(low, a) AND contains(low, b) GROUP BY id""")
def _(spark, d):
    """Names of parts against list entries made of some of them."""
    p = S.parquet(spark, d, "part")
    w = F.split("p_name", " ")
    entries = p.where("p_partkey % 40 = 0").select(F.concat(F.lit("list"), (F.col("p_partkey") % 3).cast("string")).alias("provider"), F.array(F.get(w, F.lit(0)), F.get(w, F.lit(1))).alias("parts"), S.pick(F.col("p_partkey"), ("sanctions", "pep", "adverse_media")).alias("list_type"), F.lit("strong").alias("confidence"), F.col("p_size").cast("double").alias("score"))
    names = p.select(F.col("p_name").alias("name")).distinct()  # what is found of a name is written as text once
    found = screening.matches_in(names, entries).where("size(matches) > 0")
    text = F.transform("matches", lambda m: F.concat_ws(":", m["provider"], m["list_type"], m["score"].cast("int").cast("string")))
    found = found.select("name", F.array_join(F.array_sort(F.array_distinct(text)), ",").alias("found"))
    return p.join(found, F.col("p_name") == F.col("name")).select(F.col("p_partkey").alias("id"), "found")


MATCHES = """mt AS (SELECT doc_id, lower(text) AS n FROM documents), hits AS (SELECT doc_id AS entity_id, t.* FROM mt, LATERAL (VALUES ('sanctions', 0.92, 'provider_1', contains(n, 'kim') AND contains(n, 'jong')), ('sanctions', 0.95, 'provider_1', contains(n, 'putin')), ('pep', 1.0, 'provider_1', contains(n, 'putin')),
  ('pep', 0.65, 'provider_1', regexp_matches(n, 'minister|senator|president|governor')), ('adverse_media', 0.7, 'provider_2', regexp_matches(n, 'fraud|scandal|corrupt')), ('enforcement', 0.55, 'provider_2', regexp_matches(n, 'sec|violation'))) t(kind, score, provider, hit) WHERE hit)"""


@query("scr05_match_alerts", """SELECT entity_id, a AS alert_type, score::DOUBLE AS match_score, provider AS watchlist, CASE a WHEN 'pep_match' THEN 'medium' ELSE 'critical' END AS routed_priority, 'compliance' AS routed_category
FROM (SELECT *, CASE kind WHEN 'sanctions' THEN 'sanctions_match' WHEN 'pep' THEN 'pep_match' ELSE 'watchlist_match' END AS a FROM hits)""", MATCHES)
def _(spark, d):
    n = S.parquet(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"))
    return workflow.match_alerts(screening.screen(n)).drop("matched_name")


@query("flt16_list_types", "SELECT entity_id AS id, count(*) AS match_count, max(score)::DOUBLE AS highest_score FROM hits WHERE kind IN ('adverse_media', 'enforcement') GROUP BY 1", MATCHES)
def _(spark, d):
    n = S.parquet(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"))
    return screening.screen(n, list_types=("adverse_media", "enforcement")).where("match_count > 0").select("id", F.col("match_count").cast("long").alias("match_count"), "highest_score")


@query("scr05b_one_provider", "SELECT entity_id AS id, count(*) AS match_count, max(score)::DOUBLE AS highest_score FROM hits WHERE provider = 'provider_2' GROUP BY 1", MATCHES)
def _(spark, d):
    n = S.parquet(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"))
    return screening.screen(n, providers=("provider_2",)).where("match_count > 0").select("id", F.col("match_count").cast("long").alias("match_count"), "highest_score")


def scored(spark, d):
    e = S.entities(spark, d).withColumns({"is_sanctioned": F.col("is_sanctioned") == 1, "is_pep": F.col("is_pep") == 1})
    return scoring.score(scoring.with_context(e))


SCORES = SQL["cs07_entity_scores"]
LEVEL = "CASE WHEN overall_score >= 0.8 THEN 'critical' WHEN overall_score >= 0.6 THEN 'high' WHEN overall_score >= 0.4 THEN 'medium' ELSE 'low' END"


@query("wf_score_alerts", f"SELECT id AS entity_id, 'high_risk_entity' AS alert_type, 'critical' AS priority, overall_score, {LEVEL} AS risk_level FROM ({SCORES}) WHERE overall_score >= 0.6")
def _(spark, d):
    return rounded(workflow.score_alerts(scored(spark, d)), 6, "overall_score")


@query("wf_due_diligence", f"SELECT id AS entity_id, step, task, CASE step WHEN 1 THEN 'depth=4' WHEN 2 THEN 'include_counterparties=true,lookback_days=365' ELSE '' END AS options FROM ({SCORES}), (VALUES (1, 'network_analysis'), (2, 'transaction_analysis'), (3, 'adverse_media'), (4, 'source_of_funds'), (5, 'document_verification')) t(step, task) WHERE overall_score >= 0.4 AND overall_score < 0.6")
def _(spark, d):
    out = workflow.due_diligence(scored(spark, d))
    return out.withColumn("options", F.array_join(F.array_sort(F.transform(F.map_entries("options"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ","))


@query("wf_exposure_alerts", "SELECT src AS entity_id, 'high_risk_network' AS alert_type, round(sum(risk_score), 6) AS risk_exposure, 'high' AS routed_priority, 'network' AS routed_category FROM un LEFT JOIN ent ON ent.id = un.dst WHERE src IN (SELECT id FROM ent) GROUP BY src HAVING sum(risk_score) > 20", UN, ENT)
def _(spark, d):
    v, e = edges_of(spark, d)
    return rounded(workflow.exposure_alerts(network.node_metrics(v, e), 20).drop("neighbour_count"), 6, "risk_exposure")


@query("srt07_factors", f"SELECT id, string_agg(k, ',' ORDER BY c DESC, o) AS factors FROM (SELECT ent.id, t.* FROM ent, LATERAL (VALUES ('sanctions', 0, is_sanctioned = 1, 1.0), ('pep', 1, is_pep = 1, 0.6), ('jurisdiction', 2, country IN ({', '.join(repr(k) for k in scoring.COUNTRY_SCORES)}), 0.0)) t(k, o, fires, c) WHERE fires) WHERE id % 97 = 0 OR id % 41 = 0 GROUP BY id", ENT)
def _(spark, d):
    """Entities that are sanctioned or exposed, their factors by falling contribution: sanctions, then politics, then countries, which weigh least here."""
    out = scoring.explain(scored(spark, d)).where("id % 97 = 0 or id % 41 = 0")
    return out.select("id", F.array_join(F.transform("explanation", lambda x: x["category"]), ",").alias("factors"))


@query("agg26_resolution_rate", "SELECT count(*) AS input_count, count(DISTINCT name) AS resolved_count, 1 - count(DISTINCT name) / count(*)::DOUBLE AS resolution_rate FROM ppl", PEOPLE)
def _(spark, d):
    n = name_records(spark, d)
    return resolution.resolution_rate(n, n.select("name").distinct())


@query("c302f_concatenated", f"SELECT o_custkey AS customer_id, count(*) AS items, string_agg('+' || (o_orderkey % 4) || '/' || {pick('o_orderkey', SYSTEMS)}, ',' ORDER BY o_orderkey) AS listed FROM orders GROUP BY 1")
def _(spark, d):
    """Items of all records with their source, in order and without removing any."""
    items = customer360.nested(records(spark, d), "phones")
    text = F.transform("items", lambda i: F.concat_ws("/", i["number"], i["source"]))
    return items.select("customer_id", F.size("items").cast("long").alias("items"), F.array_join(text, ",").alias("listed"))
