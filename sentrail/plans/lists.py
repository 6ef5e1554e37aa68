"""Queries of dashboards by member, lists, searches, graph iterations, fraud with profiles, and views of a customer."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import customer360 as C
from ..operators import fraud, monitoring, network, scoring, screening, search, workflow
from ..sources import tables as S
from .derived import PRIORITY_SQL, RE, records
from ..functions import text as T
from ..operators import resolution
from .queries import AL, CA, CARD, ED, ENT, PEOPLE, PR, SQL, TX, UN, code_runs, edges_of, members, people, pick, query, rounded

EN = f"en AS (SELECT o_orderkey AS id, {pick('o_orderkey', S.ENGAGEMENT_STATUS)} AS status, {pick('(o_orderkey + 1)', S.ENGAGEMENT_TYPE)} AS engagement_type, 'Trial ' || (o_orderkey % 90) AS title, 'Client ' || (o_orderkey % 50) AS client_name, o_orderdate AS created_at FROM orders)"
DE = f"de AS (SELECT o_orderkey AS id, {pick('o_orderkey', S.DEMO_TYPE)} AS demo_type, CASE WHEN o_orderkey % 3 = 0 THEN 'scheduled' ELSE 'done' END AS status, 'presenter' || (o_orderkey % 8) AS presenter, 'Client ' || (o_orderkey % 50) AS client_name, o_orderdate AS scheduled_at FROM orders)"
LB = f"lb AS (SELECT p_partkey AS id, p_name AS name, p_type AS description, p_brand AS category, {pick('p_partkey', ('aml', 'fraud', 'kyc', 'sanctions', 'network'))} AS solution_area, (p_partkey % 4 > 0)::INT AS is_active, (p_partkey % 3 > 0)::INT AS is_current, p_size AS times_used, p_partkey * 7 % 101 AS usage_count FROM part)"
PT = f"pt AS (SELECT o_orderkey AS id, {pick('o_orderkey', S.PROPOSAL_TYPE)} AS proposal_type FROM orders)"


# dashboards by member ----------------------------------------------------------


@query("agg15_case_breakdown", members("status", S.CASE_STATUS, "ca"), CA)
def _(spark, d):
    return A.breakdown(S.cases(spark, d), {"status": S.CASE_STATUS})


@query("agg16_proposal_breakdown", f"{members('status', S.PROPOSAL_STATUS, 'pr')} UNION ALL {members('proposal_type', S.PROPOSAL_TYPE, 'pt')}", PR, PT)
def _(spark, d):
    return A.breakdown(S.proposals(spark, d), {"status": S.PROPOSAL_STATUS, "proposal_type": S.PROPOSAL_TYPE})


@query("agg18_engagement_breakdown", f"{members('status', S.ENGAGEMENT_STATUS, 'en')} UNION ALL {members('engagement_type', S.ENGAGEMENT_TYPE, 'en')}", EN)
def _(spark, d):
    return A.breakdown(S.engagements(spark, d), {"status": S.ENGAGEMENT_STATUS, "engagement_type": S.ENGAGEMENT_TYPE})


@query("agg19_demo_breakdown", members("demo_type", S.DEMO_TYPE, "de"), DE)
def _(spark, d):
    return A.breakdown(S.demos(spark, d), {"demo_type": S.DEMO_TYPE})


@query("agg24_tallies", "SELECT 'currency' AS dimension, 'USD' AS member, count(*) AS row_count FROM tx WHERE sender_entity_id = 7 OR receiver_entity_id = 7 UNION ALL SELECT 'transaction_type', transaction_type, count(*) FROM tx WHERE sender_entity_id = 7 OR receiver_entity_id = 7 GROUP BY 2", TX)
def _(spark, d):
    return A.tallies(S.transactions(spark, d), 7)


@query("srt11_first_counterparties", "SELECT c AS counterparty FROM (SELECT CASE WHEN sender_entity_id = 7 THEN receiver_entity_id ELSE sender_entity_id END AS c, max((transaction_date, -id)) AS m FROM tx WHERE sender_entity_id = 7 OR receiver_entity_id = 7 GROUP BY 1) WHERE c IS NOT NULL ORDER BY m DESC, c LIMIT 50", TX)
def _(spark, d):
    return A.first_counterparties(S.transactions(spark, d), 7)


# lists -------------------------------------------------------------------------


@query("flt14_list_engagements", "SELECT id, status, engagement_type, title FROM en WHERE status = 'in_progress' AND (title ILIKE '%trial 1%' OR client_name ILIKE '%trial 1%') ORDER BY created_at DESC, id LIMIT 20", EN)
def _(spark, d):
    return A.list_engagements(S.engagements(spark, d), status="in_progress", search="trial 1")[0].select("id", "status", "engagement_type", "title")


@query("flt14_list_demos", "SELECT id, demo_type, presenter FROM de WHERE demo_type = 'custom' AND client_name ILIKE '%client 3%' AND scheduled_at >= TIMESTAMP '1995-01-01' ORDER BY scheduled_at DESC, id LIMIT 20", DE)
def _(spark, d):
    return A.list_demos(S.demos(spark, d), client="client 3", date_from=datetime(1995, 1, 1), demo_type="custom")[0].select("id", "demo_type", "presenter")


@query("flt14_list_scenarios", "SELECT id, name, times_used FROM lb WHERE is_active = 1 AND solution_area = 'kyc' ORDER BY times_used DESC, id LIMIT 20", LB)
def _(spark, d):
    return A.list_scenarios(S.library(spark, d), solution_area="kyc")[0].select("id", "name", "times_used")


@query("flt14_list_content", "SELECT id, category, usage_count FROM lb WHERE is_current = 1 AND (name ILIKE '%widget%' OR description ILIKE '%widget%') ORDER BY usage_count DESC, id LIMIT 20", LB)
def _(spark, d):
    return A.list_content(S.library(spark, d), search="widget")[0].select("id", "category", "usage_count")


@query("srt10_sections", "SELECT l_orderkey AS proposal_id, l_linenumber::VARCHAR || '.' || (l_partkey % 12) AS section_number, l_linenumber AS id FROM lineitem WHERE l_orderkey = 1 ORDER BY 2, 3")
def _(spark, d):
    number = F.concat_ws(".", F.col("l_linenumber").cast("string"), (F.col("l_partkey") % 12).cast("string"))
    s = S.parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("proposal_id"), number.alias("section_number"), F.col("l_linenumber").alias("id"))
    return A.sections(s, 1)


@query("prj03_serialised", "SELECT id, strftime(transaction_date, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(transaction_date) % 1000000 <> 0 THEN '.' || lpad((epoch_us(transaction_date) % 1000000)::VARCHAR, 6, '0') ELSE '' END AS transaction_date, is_flagged = 1 AS is_flagged FROM tx", TX)
def _(spark, d):
    return S.serialised(S.transactions(spark, d).select("id", "transaction_date", "is_flagged"), ("is_flagged",))


# monitoring --------------------------------------------------------------------


@query("tm07_all_rules", f"""SELECT alert_type, count(*) AS n, round(sum(s), 2) AS total_score FROM (
SELECT 'high_risk_jurisdiction' AS alert_type, 0.8 AS s FROM tx WHERE sender_country IN ('KP','IR','MM','SY','YE','AF') OR receiver_country IN ('KP','IR','MM','SY','YE','AF')
UNION ALL SELECT 'round_amount', CASE WHEN amount % 1000 = 0 AND amount >= 10000 THEN 0.6 WHEN amount % 1000 = 0 AND amount >= 1000 THEN 0.4 ELSE 0.2 END FROM tx WHERE amount % 500 = 0 AND amount >= 500
UNION ALL SELECT 'unusual_timing', CASE WHEN o AND k THEN 0.4 WHEN o THEN 0.3 ELSE 0.2 END FROM (SELECT hour(transaction_date) < 6 OR hour(transaction_date) > 22 AS o, dayofweek(transaction_date) IN (0, 6) AS k FROM tx) WHERE o OR k
UNION ALL SELECT 'structuring', CASE WHEN t >= 50000 THEN 0.9 WHEN t >= 25000 THEN 0.7 ELSE 0.5 END FROM (SELECT sum(amount) AS t FROM (SELECT *, time_bucket(INTERVAL 24 HOUR, transaction_date, TIMESTAMP '1970-01-01') AS w, (floor(epoch(transaction_date))::BIGINT - floor(epoch(lag(transaction_date) OVER (PARTITION BY sender_entity_id ORDER BY transaction_date, id)))::BIGINT) / 3600 AS gap FROM tx WHERE amount >= 9500 AND amount < 10000) WHERE gap <= 24 GROUP BY sender_entity_id, w HAVING count(*) >= 3 AND sum(amount) >= 10000)
UNION ALL SELECT 'velocity_spike', round(z / 10, 2) FROM (SELECT (daily_count - avg(daily_count) OVER w) / nullif(stddev(daily_count) OVER w, 0) AS z FROM (SELECT *, count(*) OVER (PARTITION BY sender_entity_id, date_trunc('day', transaction_date)) AS daily_count FROM tx) WINDOW w AS (PARTITION BY sender_entity_id ORDER BY transaction_date, id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) WHERE z >= 3) GROUP BY 1""", TX)
def _(spark, d):
    a = monitoring.all_alerts(S.transactions(spark, d))
    return a.groupBy("alert_type").agg(F.count("*").alias("n"), F.round(F.sum("risk_score"), 2).alias("total_score"))


@query("wf_routes", "SELECT id, CASE id % 8 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN 'critical' WHEN 3 THEN 'high' WHEN 5 THEN 'critical' ELSE 'medium' END AS routed_priority, CASE id % 8 WHEN 0 THEN 'risk' WHEN 1 THEN 'network' WHEN 2 THEN 'compliance' WHEN 3 THEN 'transaction' WHEN 4 THEN 'compliance' WHEN 5 THEN 'compliance' ELSE 'other' END AS routed_category FROM al", AL)
def _(spark, d):
    kinds = (*workflow.ROUTES, "manual", "unknown")
    return workflow.route(S.alerts(spark, d).withColumn("alert_type", S.pick(F.col("id"), kinds))).select("id", "routed_priority", "routed_category")


@query("wf_expired", "SELECT id FROM al WHERE detected_at < TIMESTAMP '1998-08-01' - INTERVAL 365 DAY", AL)
def _(spark, d):
    return workflow.expired(S.alerts(spark, d), "alerts", "detected_at", datetime(1998, 8, 1)).select("id")


@query("wf_engagements", "SELECT id, CASE WHEN id IN (1, 2) THEN 'in_progress' WHEN id = 3 THEN 'successful' WHEN id = 4 THEN 'unsuccessful' ELSE status END AS status FROM en", EN)
def _(spark, d):
    e = workflow.change_engagement(S.engagements(spark, d), [1, 2], "start")
    return workflow.change_engagement(workflow.change_engagement(e, [3], "successful"), [4], "unsuccessful").select("id", "status")


# searches ----------------------------------------------------------------------


def text_tokens(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '\\W+'), lambda x: x <> '')"


DOCS_SQL = f"""sx AS (SELECT id, transaction_type || ' from ' || sender_country AS description, 'REF-' || id AS reference_number FROM tx),
sa AS (SELECT id, rule_name || ' ' || category AS title, severity || ' alert for ' || assigned_to AS description, severity, status FROM al)"""


def described(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = S.transactions(spark, d).select("id", F.concat_ws(" from ", "transaction_type", "sender_country").alias("description"), F.concat(F.lit("REF-"), F.col("id").cast("string")).alias("reference_number"))
    a = S.alerts(spark, d).select("id", F.concat_ws(" ", "rule_name", "category").alias("title"), F.concat_ws(" alert for ", "severity", "assigned_to").alias("description"), "severity", "status")
    return t, a


def share(words: tuple[str, ...], c: str) -> str:
    return f"len(list_intersect([{', '.join(repr(w) for w in words)}], {text_tokens(c)}))::DOUBLE / {len(words)}"


@query("se02_search_transactions", f"SELECT id, round(s, 6) AS relevance FROM (SELECT id, {share(('kp', 'click', '41'), 'description')} + {share(('kp', 'click', '41'), 'reference_number')} AS s FROM sx) WHERE s > 0 ORDER BY s DESC, id LIMIT 20", TX, AL, DOCS_SQL)
def _(spark, d):
    return rounded(search.search_transactions(described(spark, d)[0], "KP click 41").select("id", "relevance"), 6, "relevance")


@query("se03_search_alerts", f"SELECT id, round(s, 6) AS relevance FROM (SELECT id, 2 * {share(('rule5', 'cat1', 'high'), 'title')} + {share(('rule5', 'cat1', 'high'), 'description')} AS s FROM sa WHERE status = 'new') WHERE s > 0 ORDER BY s DESC, id LIMIT 20", TX, AL, DOCS_SQL)
def _(spark, d):
    return rounded(search.search_alerts(described(spark, d)[1], "rule5 cat1 high", status="new").select("id", "relevance"), 6, "relevance")


SE_ALL = " UNION ALL ".join(
    f"(SELECT '{name}' AS index, n::VARCHAR AS id, round(s, 6) AS relevance FROM (SELECT id AS n, {' + '.join(share(('machinery', 'kp', 'rule5'), c) for c in cols)} AS s FROM {view}) WHERE s > 0 ORDER BY s DESC, n LIMIT 10)"
    for name, view, cols in (("entities", "(SELECT id, name, entity_type, country FROM ent)", ("name", "entity_type", "country")), ("transactions", "sx", ("description", "reference_number")), ("alerts", "sa", ("title", "description", "severity", "status")))
)


@query("se04_search_all", SE_ALL, TX, AL, ENT, DOCS_SQL)
def _(spark, d):
    t, a = described(spark, d)
    return rounded(search.search_all({"entities": S.entities(spark, d), "transactions": t, "alerts": a}, "machinery kp rule5"), 6, "relevance")


def close_share(words: tuple[str, ...], c: str) -> str:
    close = "levenshtein(w, t) <= CASE WHEN length(w) <= 2 THEN 0 WHEN length(w) <= 5 THEN 1 ELSE 2 END"
    return f"len(list_filter([{', '.join(repr(w) for w in words)}], lambda w: len(list_filter({text_tokens(c)}, lambda t: {close})) > 0))::DOUBLE / {len(words)}"


SQL["se01_search_entities"] = f"WITH {ENT} SELECT id, name, risk_score, 3 * s AS relevance FROM (SELECT *, {close_share(('customer',), 'name')} AS s FROM ent WHERE risk_score BETWEEN 0.5 AND 1) WHERE s > 0 ORDER BY risk_score DESC, s DESC, id LIMIT 20"
SQL["scr06_screen_index"] = f"WITH {ENT}, h AS (SELECT id, name, {close_share(('customer', '000000097'), 'name')} AS match_score FROM ent WHERE is_sanctioned = 1) SELECT id, name, match_score FROM h WHERE match_score > 0 AND match_score >= 0.8::DOUBLE * (SELECT max(match_score) FROM h) ORDER BY match_score DESC, id LIMIT 10"
SQL["cs09_batch_summary"] = SQL["cs07_entity_scores"].replace("SELECT id, round(", "SELECT count(*) AS total, count(*) FILTER (round(s, 12) >= 0.6) AS high_risk, round(avg(s), 6) AS avg_score FROM (SELECT round(", 1).replace("::DOUBLE, 6) AS overall_score", "::DOUBLE, 15) AS s", 1) + ")"


@query("se06_index_changes", "SELECT id, CASE WHEN id % 50 = 0 THEN 'renamed' ELSE name END AS name FROM ent WHERE id % 50 <> 1", ENT)
def _(spark, d):
    e = S.entities(spark, d).select("id", "name")
    e = search.index_documents(e, e.where("id % 50 = 0").withColumn("name", F.lit("renamed")))
    return search.delete_documents(e, e.where("id % 50 = 1").select("id"))


# graph -------------------------------------------------------------------------

RANKS = "sh AS (SELECT src, dst, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY src) AS share FROM ed GROUP BY 1, 2), r0 AS (SELECT id, 1.0::DOUBLE AS x FROM ent)" + "".join(
    f", r{i} AS MATERIALIZED (SELECT ent.id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(g.x, 0) AS x FROM ent LEFT JOIN (SELECT dst, sum(x * share) AS x FROM sh JOIN r{i - 1} ON sh.src = r{i - 1}.id GROUP BY 1) g ON g.dst = ent.id)" for i in range(1, 21)
)
SQL["gr03_pagerank"] = f"WITH {ED}, {ENT}, {RANKS} SELECT id, round(x * (SELECT count(*) FROM r20) / (SELECT sum(x) FROM r20), 6) AS pagerank FROM r20"
SQL["gr22_shortest_path"] = f"""WITH RECURSIVE {UN}, p(id, path) AS (SELECT 1::BIGINT, [1::BIGINT] UNION ALL SELECT un.dst, list_append(p.path, un.dst) FROM p JOIN un ON un.src = p.id WHERE len(p.path) <= 4 AND p.id <> 50 AND NOT list_contains(p.path, un.dst))
SELECT len(path)::INT - 1 AS length, array_to_string(path, ',') AS path FROM p WHERE id = 50 ORDER BY len(path), path LIMIT 1"""
VOTES = "both_ AS (SELECT src, dst, count(*) AS w FROM (SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed) GROUP BY 1, 2), l0 AS (SELECT id, id AS label FROM ent)" + "".join(
    f", l{i} AS MATERIALIZED (SELECT l.id, coalesce(b.label, l.label) AS label FROM l{i - 1} l LEFT JOIN (SELECT id, arg_min(label, (-n, label)) AS label FROM (SELECT both_.dst AS id, label, sum(w) AS n FROM both_ JOIN l{i - 1} q ON q.id = both_.src GROUP BY 1, 2) GROUP BY 1) b ON b.id = l.id)" for i in range(1, 11)
)
SQL["gr04_communities"] = f"""WITH {ED}, {ENT}, {VOTES} SELECT label, size, round(avg_risk, 6) AS avg_risk, sanctioned, peps, round(CASE WHEN sanctioned > 0 THEN 0.9 WHEN peps > 0 THEN 0.7 WHEN avg_risk >= 0.5 THEN 0.6 ELSE avg_risk END, 6)::DOUBLE AS community_risk
FROM (SELECT label, count(*) AS size, avg(risk_score) AS avg_risk, sum(is_sanctioned)::BIGINT AS sanctioned, sum(is_pep)::BIGINT AS peps FROM l10 JOIN ent USING (id) GROUP BY 1)"""


@query("gr07_pair_spread", "SELECT src, dst, round(stddev(amount), 4) AS std_flow FROM ed GROUP BY 1, 2 HAVING sum(amount) >= 10000", ED)
def _(spark, d):
    return rounded(network.pair_flows(edges_of(spark, d)[1]).select("src", "dst", "std_flow"), 4, "std_flow")


@query("gr16_shared_classes", """SELECT k AS relationship_type, v AS value, min(id) AS root, count(*) AS members, (count(*) * (count(*) - 1) // 2) AS links FROM (
SELECT 'CO_LOCATED' AS k, (c_custkey // 300)::VARCHAR AS v, c_custkey AS id FROM customer UNION ALL SELECT 'SHARES_PHONE', (c_custkey // 2)::VARCHAR, c_custkey FROM customer) GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, d):
    k = F.col("c_custkey")
    n = S.parquet(spark, d, "customer").select(k.alias("id"), k.alias("ord"), F.create_map(F.lit("address"), F.floor(k / 300).cast("string"), F.lit("phone"), F.floor(k / 2).cast("string")).alias("attributes"))
    return network.shared_classes(n)


def small_network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers, links to the next one of a known or unknown type, their payments, and what is inferred."""
    k = F.col("c_custkey")
    c = S.parquet(spark, d, "customer")
    nodes = c.select(k.alias("id"), k.alias("ord"), F.lower("c_mktsegment").alias("entity_type"), F.col("c_name").alias("name"), F.create_map(F.lit("phone"), F.floor(k / 2).cast("string")).alias("attributes"), (k % 101 / 100.0).alias("risk_score"))
    edges = c.select(k.alias("src"), (k + 1).alias("dst"), k.alias("ord"), F.when(k % 2 == 0, "OWNS").otherwise("friend").alias("relationship_type"))
    return network.generate_network(nodes, edges, edges_of(spark, d)[1])


@query("gr19_network_types", """SELECT 'relationship_type' AS dimension, 'SENT_TO' AS member, count(*) AS row_count FROM (SELECT DISTINCT src, dst FROM ed) UNION ALL SELECT 'relationship_type', CASE WHEN c_custkey % 2 = 0 THEN 'OWNS' ELSE 'RELATED_TO' END, count(*) FROM customer GROUP BY 2
UNION ALL SELECT 'relationship_type', 'SHARES_PHONE', count(*) FROM customer a JOIN customer b ON a.c_custkey // 2 = b.c_custkey // 2 AND a.c_custkey < b.c_custkey
UNION ALL SELECT 'relationship_type', 'TRANSACTED_WITH', count(*) FROM (SELECT 1 FROM ed WHERE src <> dst GROUP BY least(src, dst), greatest(src, dst) HAVING count(*) >= 3) UNION ALL SELECT 'node_type', lower(c_mktsegment), count(*) FROM customer GROUP BY 2""", ED)
def _(spark, d):
    return network.type_counts(*small_network(spark, d))


@query("gr10_network_edges", "SELECT id, src, dst FROM ed WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) ORDER BY src, dst, id LIMIT 200", UN, ENT, "n AS (SELECT id FROM (SELECT id, min(h) AS h FROM (SELECT 3 AS id, 0 AS h UNION ALL SELECT dst, 1 FROM un WHERE src = 3 UNION ALL SELECT b.dst, 2 FROM un a JOIN un b ON a.dst = b.src WHERE a.src = 3) GROUP BY 1 ORDER BY 2, 1 LIMIT 100) JOIN ent USING (id))")
def _(spark, d):
    v, e = edges_of(spark, d)
    return network.entity_network(v, e.select("src", "dst", "id"), 3)[1].select("id", "src", "dst")


@query("src05_pattern", "SELECT a.id AS source_id, a.name AS source_name, 'SENT_TO' AS relationship_type, b.id AS target_id, b.name AS target_name FROM (SELECT DISTINCT src, dst FROM ed) e JOIN ent a ON a.id = e.src JOIN ent b ON b.id = e.dst WHERE a.entity_type = 'machinery' AND b.entity_type = 'building'", ED, ENT)
def _(spark, d):
    v, e = edges_of(spark, d)
    return network.match_pattern(v, network.relationships_from_transactions(e), "SENT_TO", "machinery", "building")


@query("snk04_create_relationships", "SELECT src, dst FROM (SELECT c_custkey AS src, c_custkey + 10 AS dst FROM customer) WHERE dst IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    c = S.parquet(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    rows = c.select(F.col("id").alias("src"), (F.col("id") + 10).alias("dst"))
    return network.create_relationships(c, rows.limit(0), rows)


@query("gr23_louvain")
def _(spark, d):
    """No SQL: each level works on the communities of the one before until nothing moves."""
    v, e = edges_of(spark, d)
    return network.communities(v, e).select("community", "size", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


PG = ED + ", pe AS (SELECT src, dst, arg_max(amount, (ts, id)) AS weight, arg_max(id, (ts, id)) AS ord, substr(md5(src || '_' || dst || '_SENT_TO'), 1, 16) AS edge_id FROM ed GROUP BY src, dst), bo AS (SELECT src, dst, edge_id, ord, weight FROM pe UNION ALL SELECT dst, src, edge_id, ord, weight FROM pe WHERE src <> dst)"
TRAILS = "tr AS (SELECT dst AS id, 1 AS distance, [edge_id] AS path FROM bo WHERE src = 3 UNION ALL SELECT b.dst, 2, [a.edge_id, b.edge_id] FROM bo a JOIN bo b ON a.dst = b.src AND a.edge_id <> b.edge_id WHERE a.src = 3)"


def payments_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v, e = edges_of(spark, d)
    return v, network.relationships_from_transactions(e).withColumns({"ord": F.col("transaction_id"), "confidence": F.lit(1.0)})


@query("gr20_relationships", "SELECT id, distance, 'SENT_TO' AS relationship_type, array_to_string(path, ',') AS path FROM tr ORDER BY distance, id, tr.path LIMIT 100", PG, TRAILS)
def _(spark, d):
    return network.entity_relationships(payments_of(spark, d)[1], 3).withColumn("path", F.array_join("path", ","))


@query("gr25_path_risk", "SELECT id, distance, round((SELECT risk_score FROM ent WHERE id = 3) / distance, 6) AS propagated_risk FROM tr WHERE id <> 3 ORDER BY 3 DESC, id, path LIMIT 50", PG, TRAILS, ENT)
def _(spark, d):
    v, e = payments_of(spark, d)
    return rounded(network.path_risk(v, e, 3, 2).select("id", "distance", "propagated_risk"), 6, "propagated_risk")


@query("gr11_propagated_risk", """SELECT id, hops, round((SELECT risk_score FROM ent WHERE id = 3) * pow(0.5, hops) * w, 6) AS risk FROM (SELECT 3::BIGINT AS id, 0 AS hops, 1.0::DOUBLE AS w UNION ALL SELECT dst, 1, arg_min(weight, ord) FROM bo WHERE src = 3 AND dst <> 3 GROUP BY dst
UNION ALL SELECT dst, 2, arg_min(weight, ord) FROM bo WHERE src IN (SELECT dst FROM bo WHERE src = 3) AND src <> 3 AND dst <> 3 AND dst NOT IN (SELECT dst FROM bo WHERE src = 3) GROUP BY dst)""", PG, ENT)
def _(spark, d):
    v, e = payments_of(spark, d)
    return rounded(network.propagate_risk(v, e, 3, 2), 6, "risk")


@query("gr24_top_pagerank", "SELECT id, round(x * (SELECT count(*) FROM r20) / (SELECT sum(x) FROM r20), 6) AS score FROM r20 ORDER BY x DESC, id LIMIT 20", ED, ENT, RANKS)
def _(spark, d):
    v, e = edges_of(spark, d)
    return rounded(network.centrality(v, e, "pagerank"), 6, "score")


# names -------------------------------------------------------------------------

CODED_SQL = "CASE WHEN name = '' THEN '0000' ELSE rpad(upper(substr(name, 1, 1)) || substr(replace(substr(" + code_runs("regexp_replace(upper(name), '[^BFPVCGJKQSXZDTLMNR]', '0', 'g')", "BFPVCGJKQSXZDTLMNR", "111122222222334556", "0123456") + ", 2), '0', ''), 1, 3), 4, '0') END"
META_SQL = "regexp_replace(upper(name), '[^A-Z]', '', 'g')"
for _pattern, _by in T.PHONETIC:
    META_SQL = f"regexp_replace({META_SQL}, '{_pattern}', '{_by}', 'g')"
TITLE_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(name, '\b(" + "|".join(T.TITLES) + r")\b\.?', '', 'gi'), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))"


@query("str_keys", f"""SELECT id, lower(trim(regexp_replace(name, '[^a-zA-Z0-9\\s]', '', 'g'))) AS normalized, {TITLE_SQL} AS standard, {CODED_SQL} AS coded, substr({META_SQL}, 1, 6) AS metaphone,
substr(lower(replace(name, ' ', '')), 1, 3) || ',' || substr(lower(replace(name, ' ', '')), 2, 3) || ',' || substr(lower(replace(name, ' ', '')), 3, 3) AS grams, upper(substr(name, 1, 1)) || '_' || coalesce(birth_year, '0000') AS letter_year FROM ppl""", PEOPLE)
def _(spark, d):
    p = people(spark, d)
    n, born = F.element_at("attributes", "name"), F.substring(F.element_at("attributes", "date_of_birth"), 1, 4)
    letter = F.substring(F.get(resolution.STRATEGIES["first_letter"](n, born), F.lit(0)), 4, 20)
    return p.select("id", T.normalized_name(n).alias("normalized"), T.standard_name(n).alias("standard"), T.coded_soundex(n).alias("coded"), T.metaphone(n).alias("metaphone"), F.array_join(T.blocking_ngrams(n), ",").alias("grams"), letter.alias("letter_year"))


@query("erb02_blocking_keys", f"""SELECT id, unnest(list_distinct(['soundex_' || {CODED_SQL}, 'metaphone_' || substr({META_SQL}, 1, 6), 'fl_' || upper(substr(name, 1, 1)) || '_' || coalesce(birth_year, '0000')])) AS block FROM ppl""", PEOPLE)
def _(spark, d):
    return resolution.blocking_keys(people(spark, d), ("soundex", "metaphone", "first_letter"))


@query("str_places", "SELECT s_suppkey AS id, upper(substr(n_name, 1, 2)) || '_' || upper(substr(r_name, 1, 3)) AS location, regexp_replace(regexp_replace(s_suppkey || ' High Street, Old road', 'street', 'St', 'i'), 'road', 'Rd', 'i') AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    s = S.parquet(spark, d, "supplier").join(S.parquet(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(S.parquet(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    address = T.standard_address(F.concat(F.col("s_suppkey").cast("string"), F.lit(" High Street, Old road")))
    return s.select(F.col("s_suppkey").alias("id"), resolution.location_key(F.col("n_name"), F.col("r_name")).alias("location"), address.alias("address"))


@query("j21_name_lookup", "SELECT q AS query, id, name, 0.9::DOUBLE AS confidence FROM (SELECT q, id, name, row_number() OVER (PARTITION BY q ORDER BY id) AS k FROM ent, (SELECT DISTINCT p_size::VARCHAR AS q FROM part) WHERE contains(lower(name), lower(q))) WHERE k <= 5", ENT)
def _(spark, d):
    names = S.parquet(spark, d, "part").select(F.col("p_size").cast("string").alias("name"))
    return resolution.lookup_names(names, S.entities(spark, d))


# fraud with profiles, mixers and odd rows ----------------------------------------

CARD2 = CARD.replace("SELECT id AS", "SELECT CASE id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS present, CASE id % 5 WHEN 0 THEN false WHEN 1 THEN true END AS cvv, id % 6 = 0 AS avs, id % 7 = 0 AS ds, id AS", 1)


@query("cc05_card_profiles", """SELECT transaction_id, round(least(1.0, round(CASE WHEN amount < 5 AND max_before > amount OR declined >= 3 THEN 0.4 ELSE 0 END + CASE WHEN n24 > 10 THEN 0.3 ELSE 0 END + CASE WHEN mcc IN ('5967', '7995') THEN 0.2 ELSE 0 END + CASE WHEN (floor(epoch(ts))::BIGINT - floor(epoch(other_at))::BIGINT) / 3600 < 3 THEN 0.5 ELSE 0 END
+ CASE WHEN NOT present THEN CASE WHEN coalesce(cvv, false) THEN 0 ELSE 0.25 END + CASE WHEN avs THEN 0 ELSE 0.2 END + CASE WHEN ds THEN 0 ELSE 0.15 END ELSE 0 END
+ CASE WHEN cardholder_id % 2 = 0 THEN CASE WHEN (amount - 10) / 2 > 3 THEN 0.2 ELSE 0 END + CASE WHEN mcc <> '5411' THEN 0.1 ELSE 0 END + CASE WHEN hour(ts) BETWEEN 8 AND 21 THEN 0 ELSE 0.1 END ELSE 0 END, 9))::DOUBLE, 6) AS fraud_score FROM (
SELECT *, max(amount) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS max_before, sum((status = 'declined')::INT) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS declined, count(*) OVER (PARTITION BY cardholder_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) - 1 AS n24,
(SELECT max(o.ts) FROM cd o WHERE o.cardholder_id = c.cardholder_id AND o.merchant_country <> c.merchant_country AND (o.ts, o.transaction_id) < (c.ts, c.transaction_id)) AS other_at FROM cd c WINDOW w AS (PARTITION BY cardholder_id ORDER BY ts, transaction_id)) WHERE fraud_score > 0""", TX, CARD2)
def _(spark, d):
    t, k = S.transactions(spark, d), F.col("id")
    c = t.select(
        k.alias("transaction_id"), F.col("sender_entity_id").alias("cardholder_id"), (F.col("amount") / 100).alias("amount"), S.pick(k, ("US", "GB", "FR")).alias("merchant_country"), F.when(F.col("is_flagged") == 1, "declined").otherwise("approved").alias("status"),
        S.pick(k, ("5967", "5411", "7995", "5812")).alias("mcc"), F.col("transaction_date").alias("timestamp"), F.when(k % 4 == 0, True).when(k % 4 < 3, False).alias("is_card_present"), F.when(k % 5 == 0, False).when(k % 5 == 1, True).alias("cvv_match"), (k % 6 == 0).alias("avs_match"), (k % 7 == 0).alias("three_ds"),
    )
    p = c.select("cardholder_id").where("cardholder_id % 2 = 0").distinct().select("cardholder_id", F.lit(10.0).alias("avg_transaction_amount"), F.lit(2.0).alias("std_transaction_amount"), F.array(F.lit("5411")).alias("usual_mccs"), F.lit(None).cast("array<int>").alias("usual_hours"))
    return rounded(fraud.card_fraud(c, p).select("transaction_id", "fraud_score"), 6, "fraud_score")


@query("bc01_tainted_wallets", """SELECT id, round(least(1.0, CASE WHEN id % 10 = 1 THEN 0.7 ELSE 0 END + CASE WHEN sender_entity_id % 50 = 3 THEN 0.6 ELSE 0 END + CASE WHEN id % 10 = 2 THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS fraud_score,
CASE WHEN id % 10 = 2 THEN 'Block transaction immediately - OFAC/sanctions violation' WHEN id % 10 = 1 AND sender_entity_id % 50 = 3 THEN 'Freeze wallet and file SAR' ELSE 'Enhanced due diligence and transaction review' END AS recommended_action FROM tx WHERE id % 10 IN (1, 2) OR sender_entity_id % 50 = 3""", TX)
def _(spark, d):
    t, k = S.transactions(spark, d), F.col("id")
    to = F.when(k % 10 == 1, F.concat(F.lit("Tornado-"), k.cast("string"))).when(k % 10 == 2, F.lit("0X8589aa")).otherwise("plain")
    source = F.when(F.col("sender_entity_id") % 50 == 3, "wasabi-pool").otherwise(F.concat(F.lit("a"), k.cast("string")))
    w = t.select(k.alias("tx_hash"), source.alias("from_address"), to.alias("to_address"), F.lit(5.0).alias("amount"), F.lit("BTC").alias("currency"), (F.col("transaction_date") + F.make_dt_interval(hours=k)).alias("timestamp"))
    # only the checks of addresses are looked at here
    found = fraud.wallet_fraud(w).withColumn("names", F.array_intersect("indicators", F.array(*map(F.lit, ("mixer_usage", "mixer_source", "sanctioned_address"))))).where("size(names) > 0")
    total = F.aggregate("names", F.lit(0.0), lambda a, x: a + F.when(x == "mixer_usage", 0.7).when(x == "mixer_source", 0.6).otherwise(1.0))
    score = F.round(F.least(F.lit(1.0), total), 6)
    act = F.when(F.array_contains("names", "sanctioned_address"), fraud.SANCTIONED_ACTION).when(score >= 0.8, fraud.WALLET_ACTIONS["critical"]).otherwise(fraud.WALLET_ACTIONS["high"])
    return found.select(F.col("tx_hash").alias("id"), score.alias("fraud_score"), act.alias("recommended_action"))


LOANS = """ln AS (SELECT o_orderkey AS id, o_custkey AS who, o_totalprice AS income, 'P' || (o_custkey % 100) AS name, '19' || (50 + o_custkey % 40) AS dob FROM orders),
bu AS (SELECT c_custkey AS who, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 5 * 40000.0::DOUBLE END AS income, 'p' || (c_custkey % 90) AS name, CASE WHEN c_custkey % 3 > 0 THEN '19' || (50 + c_custkey % 41) ELSE '' END AS dob, c_custkey % 17 = 0 AS ssn, c_custkey % 30 AS age, c_custkey % 9 AS accounts, c_custkey % 4 AS places, c_custkey % 6 AS users FROM customer WHERE c_custkey % 10 > 0)"""


@query("lf01_lending_bureau", """SELECT id AS application_id, round(least(1.0, CASE WHEN b.income > 0 AND l.income / b.income > 2 THEN 0.4 ELSE 0 END + CASE WHEN lower(l.name) <> lower(b.name) THEN 0.2 ELSE 0 END + CASE WHEN b.dob <> '' AND l.dob <> b.dob THEN 0.3 ELSE 0 END + CASE WHEN ssn THEN 0.4 ELSE 0 END
+ CASE WHEN age < 12 AND accounts >= 5 THEN 0.3 ELSE 0 END + CASE WHEN places = 0 THEN 0.2 ELSE 0 END + CASE WHEN users > 3 THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS fraud_score FROM ln l LEFT JOIN bu b USING (who) WHERE fraud_score > 0""", LOANS)
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    device = F.lit(None).cast("struct<is_vpn boolean, is_proxy boolean, other_identities_count int, geo_mismatch boolean>")
    a = S.parquet(spark, d, "orders").select(
        k.alias("application_id"), c.alias("applicant_id"), F.col("o_totalprice").alias("annual_income"), F.concat(F.lit("P"), text(c % 100)).alias("name"), F.concat(F.lit("19"), text(50 + c % 40)).alias("date_of_birth"),
        F.lit(24).alias("employment_length_months"), F.lit("employed").alias("employment_type"), F.lit(True).alias("business_verified"), device.alias("device_info"),
    )
    b = F.col("c_custkey")
    bureau = S.parquet(spark, d, "customer").where(b % 10 > 0).select(
        b.alias("applicant_id"), F.when(b % 5 > 0, b % 5 * 40000.0).alias("estimated_income"), F.concat(F.lit("p"), text(b % 90)).alias("name"), F.when(b % 3 > 0, F.concat(F.lit("19"), text(50 + b % 41))).otherwise("").alias("date_of_birth"),
        (b % 17 == 0).alias("ssn_issues"), (b % 30).alias("credit_file_age_months"), (b % 9).alias("account_count"), F.when(b % 4 > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("historical_addresses"), (b % 6).alias("authorized_user_accounts"),
    )
    return rounded(fraud.detect("lending", a, None, bureau).select(F.col("transaction_id").cast("long").alias("application_id"), "fraud_score"), 6, "fraud_score")


# scoring with context, screening records, customer views --------------------------


def contexts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    net = F.struct((k % 6).cast("int").alias("high_risk_connections"), (k % 4).cast("int").alias("sanctioned_connections"), (k % 10 / 10.0).alias("clustering_coefficient"), (k % 11 / 10.0).alias("centrality_score"), (k % 13 == 0).alias("in_circular_flow"), (k % 7 / 10.0).alias("propagated_risk"))
    stats = F.struct((k % 3 * 600000.0).alias("total_volume"), (k % 9 / 10.0).alias("structuring_indicator"), (k % 12 / 10.0).alias("passthrough_ratio"), (k % 8 / 10.0).alias("round_amount_ratio"), (k % 10 / 10.0).alias("cross_border_ratio"), (k % 5 / 10.0).alias("cash_ratio"))
    own = F.struct((k % 5 / 10.0).alias("off_hours_ratio"), (k % 6 * 1.0).alias("activity_spike"), (k % 9 / 10.0).alias("pattern_change_score"), (k % 15 == 0).alias("dormant_reactivation"))
    return S.parquet(spark, d, "customer").where(k % 10 > 0).select(k.alias("id"), net.cast(scoring.NETWORK).alias("network"), stats.cast(scoring.STATS).alias("transaction_stats"), own.cast(scoring.BEHAVIOUR).alias("behavioral"))


def summed(*parts: tuple[str, str]) -> str:
    return "least(1.0::DOUBLE, " + " + ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for c, v in parts) + ")"


PATTERN_SUM = summed(("k % 3 * 600000 > 1000000", "0.2"), ("k % 9 > 7", "0.4"), ("k % 12 > 9", "0.3"), ("k % 8 > 5", "0.1"), ("k % 10 > 7", "0.2"), ("k % 5 > 4", "0.2"))
NETWORK_SUM = summed(("k % 6 > 0", "least(0.4, k % 6 * 0.1)"), ("k % 4 > 0", "least(0.5, k % 4 * 0.2)"), ("k % 10 > 7", "0.15"), ("k % 11 > 8", "0.1"), ("k % 13 = 0", "0.3"), ("k % 7 > 3", "k % 7 / 10.0 * 0.5"))
BEHAVIOUR_SUM = summed(("k % 5 > 3", "0.15"), ("k % 6 > 3", "0.25"), ("k % 9 > 7", "0.2"), ("k % 15 = 0", "0.3"))


@query("cs04_context_factors", f"""SELECT k AS id, round(CASE WHEN k % 10 > 0 AND p > 0 THEN p END, 6)::DOUBLE AS pattern, round(CASE WHEN k % 10 > 0 AND n > 0 THEN n END, 6)::DOUBLE AS network, round(CASE WHEN k % 10 > 0 AND b > 0 THEN b END, 6)::DOUBLE AS behaviour FROM (SELECT c_custkey AS k, {PATTERN_SUM} AS p, {NETWORK_SUM} AS n, {BEHAVIOUR_SUM} AS b FROM (SELECT *, c_custkey AS k FROM customer))""")
def _(spark, d):
    e = S.entities(spark, d).withColumns({"is_sanctioned": F.col("is_sanctioned") == 1, "is_pep": F.col("is_pep") == 1})
    scored = scoring.score(scoring.with_context(e, contexts(spark, d)))
    of = lambda c: F.round(F.get(F.filter("factors", lambda x: x["category"] == c), F.lit(0))["score"], 6)
    return scored.select("id", of("transaction_pattern").alias("pattern"), of("network").alias("network"), of("behavioral").alias("behaviour"))


@query("scr05_match_records", """SELECT id, list_source, list_type, match_score FROM (SELECT doc_id AS id, lower(text) AS n FROM documents), (VALUES ('provider_1', 'sanctions', 0.95::DOUBLE, 1), ('provider_1', 'pep', 1.0, 1), ('provider_1', 'sanctions', 0.92, 2), ('provider_1', 'pep', 0.65, 3), ('provider_2', 'adverse_media', 0.7, 4), ('provider_2', 'enforcement', 0.55, 5)) t(list_source, list_type, match_score, k)
WHERE CASE k WHEN 1 THEN contains(n, 'putin') WHEN 2 THEN contains(n, 'kim') AND contains(n, 'jong') WHEN 3 THEN contains(n, 'minister') OR contains(n, 'senator') OR contains(n, 'president') OR contains(n, 'governor') WHEN 4 THEN contains(n, 'fraud') OR contains(n, 'scandal') OR contains(n, 'corrupt') ELSE contains(n, 'sec') OR contains(n, 'violation') END""")
def _(spark, d):
    n = S.parquet(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"))
    return screening.match_records(screening.screen(n)).select("id", "list_source", "list_type", "match_score")


def items_sql(item: str, key: str | None, where: str = "true") -> str:
    """Items of all records in order, the first of each key."""
    first = f"(SELECT customer_id, arg_min({item} || '@' || source_system, pos) AS x, min(pos) AS pos FROM re WHERE {where} GROUP BY customer_id, {key})" if key else f"(SELECT customer_id, {item} || '@' || source_system AS x, pos FROM re)"
    return f"SELECT customer_id, string_agg(x, ',' ORDER BY pos) AS items FROM {first} GROUP BY 1"


def items(spark: SparkSession, d: str, name: str, fields: dict, keys: tuple[str, ...], lower: bool = False, non_empty: bool = False) -> DataFrame:
    r = records(spark, d).withColumn(name, F.array(F.struct(*[c.cast("string").alias(f) for f, c in fields.items()])))
    got = C.nested(r, name, keys, lower, non_empty)
    return got.select("customer_id", F.array_join(F.transform("items", lambda x: F.concat(F.concat_ws("-", *[x[f] for f in fields]), F.lit("@"), x["source"])), ",").alias("items"))


@query("c302a_addresses", items_sql("'L' || (pos % 3) || '-P' || (pos % 2)", "'L' || (pos % 3) || '-P' || (pos % 2)"), RE)
def _(spark, d):
    k = F.col("pos")
    return items(spark, d, "addresses", {"line1": F.concat(F.lit("L"), (k % 3).cast("string")), "postal_code": F.concat(F.lit("P"), (k % 2).cast("string"))}, ("line1", "postal_code"))


@query("c302c_emails", items_sql("CASE WHEN pos % 6 = 0 THEN '' WHEN pos % 2 = 0 THEN 'Mail' || (pos % 4) ELSE 'mail' || (pos % 4) END", "lower(CASE WHEN pos % 6 = 0 THEN '' ELSE 'mail' || (pos % 4) END)", "pos % 6 <> 0"), RE)
def _(spark, d):
    k = F.col("pos")
    n = (k % 4).cast("string")
    return items(spark, d, "emails", {"address": F.when(k % 6 == 0, "").when(k % 2 == 0, F.concat(F.lit("Mail"), n)).otherwise(F.concat(F.lit("mail"), n))}, ("address",), True, True)


@query("c302d_identities", items_sql("'id' || (pos % 2)", None), RE)
def _(spark, d):
    return items(spark, d, "identities", {"number": F.concat(F.lit("id"), (F.col("pos") % 2).cast("string"))}, ())


@query("c302e_documents", items_sql("'t' || (pos % 2) || '-' || (pos % 5)", "'t' || (pos % 2) || '-' || (pos % 5)"), RE)
def _(spark, d):
    return items(spark, d, "documents", {"type": F.concat(F.lit("t"), (F.col("pos") % 2).cast("string")), "number": F.col("pos") % 5}, ("type", "number"))


@query("c303_accounts", "SELECT customer_id, count(*) AS account_count, round(sum(price), 2) AS total_balance FROM (SELECT customer_id, arg_min(price, pos) AS price FROM re GROUP BY customer_id, pos % 3) GROUP BY 1", RE)
def _(spark, d):
    account = F.struct((F.col("pos") % 3).cast("string").alias("account_id"), F.lit("current").alias("account_type"), F.col("price").cast("double").alias("balance"), F.lit(None).cast("double").alias("credit_limit"), F.lit("USD").alias("currency"))
    a = C.nested(records(spark, d).withColumn("accounts", F.array(account)), "accounts", ("account_id",))
    return C.financial_summary(a).select("customer_id", "account_count", F.round("total_balance", 2).alias("total_balance"))


@query("c306_first_flagged", "SELECT customer_id, bool_or(is_sanctioned) AS is_sanctioned, arg_min(source_system, pos) FILTER (is_sanctioned) AS source_system, arg_min(updated_at, pos) FILTER (is_sanctioned) AS updated_at FROM re GROUP BY 1", RE)
def _(spark, d):
    return C.first_flagged(records(spark, d), "is_sanctioned", ("source_system", "updated_at")).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("set06_attribute_keys", "SELECT customer_id, array_to_string(list_sort(list_concat(['name'], CASE WHEN bool_or(date_of_birth IS NOT NULL) THEN ['date_of_birth'] ELSE [] END, CASE WHEN bool_or(email <> '') THEN ['email'] ELSE [] END)), ',') AS keys FROM re GROUP BY 1", RE)
def _(spark, d):
    m = F.map_filter(F.create_map(*[x for c in ("name", "date_of_birth", "email") for x in (F.lit(c), F.col(c))]), lambda _, v: F.coalesce(v, F.lit("")) != "")
    return C.attribute_keys(records(spark, d).withColumn("attributes", m)).select("customer_id", F.array_join("keys", ",").alias("keys"))


@query("c301_by_confidence", f"SELECT customer_id, arg_min('o' || pos, (-(pos % 4)::DOUBLE / 4, {PRIORITY_SQL}, pos)) AS occupation, arg_min(name, ({PRIORITY_SQL}, pos)) AS name, arg_min('t' || pos, (-epoch(updated_at), {PRIORITY_SQL}, pos)) AS phone FROM re GROUP BY 1", RE)
def _(spark, d):
    pos = F.col("pos").cast("string")
    attributes = F.create_map(F.lit("occupation"), F.concat(F.lit("o"), pos), F.lit("name"), F.col("name"), F.lit("phone"), F.concat(F.lit("t"), pos))
    g = C.golden_attributes(records(spark, d).withColumns({"attributes": attributes, "confidences": F.create_map(F.lit("occupation"), F.col("pos") % 4 / 4)}))
    return g.select("customer_id", *[F.element_at("attributes", c).alias(c) for c in ("occupation", "name", "phone")])


@query("c308_view", f"""SELECT customer_id, arg_min(name, ({PRIORITY_SQL}, pos)) AS name, count(DISTINCT phone) AS phones, coalesce(max(risk_score) FILTER (risk_score <> 0), 0)::DOUBLE AS max_risk, bool_or(is_pep) AS is_pep, arg_max(kyc, (updated_at, -pos)) FILTER (kyc IS NOT NULL) AS kyc, string_agg(DISTINCT source_system, ',' ORDER BY source_system) AS sources FROM re GROUP BY 1""", RE)
def _(spark, d):
    r = records(spark, d).withColumn("nationality", F.lit(None).cast("string"))
    v = C.build_view(r, ("name", "date_of_birth", "email"), datetime(1998, 9, 1))
    return v.select("customer_id", F.col("golden_record.name").alias("name"), F.size("contact.phones").cast("long").alias("phones"), F.col("risk_profile.max_risk").alias("max_risk"), F.col("compliance.is_pep").alias("is_pep"), F.col("compliance.kyc.status").alias("kyc"), F.array_join("source_systems", ",").alias("sources"))
