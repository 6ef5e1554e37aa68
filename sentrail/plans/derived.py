"""Queries over records derived from the driver's tables: customers, loans, inferred links, workflow and changes of rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import customer360 as C
from ..operators import fraud, network, workflow
from ..sources import tables as S
from .queries import AL, CA, ED, ENT, PR, TX, UN, edges_of, pick, query, rounded

SYSTEMS = (*C.PRIORITY, "spreadsheet")
PRIORITY_SQL = "CASE source_system " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.PRIORITY.items()) + " ELSE 99 END"
# one source record for each order of a customer
RE = f"""re AS (SELECT o_custkey AS customer_id, o_orderkey AS pos, {pick("o_orderkey", SYSTEMS)} AS source_system, o_orderdate AS updated_at, 'Customer ' || o_custkey || CASE WHEN o_orderkey % 10 = 0 THEN ' Ltd' ELSE '' END AS name,
  CASE WHEN o_orderkey % 4 > 0 THEN '19' || (50 + o_custkey % 40) || '-01-02' END AS date_of_birth, CASE WHEN o_orderkey % 5 > 0 THEN 'c' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '@' END || 'mail' ELSE '' END AS email,
  o_orderkey % 101 / 100.0 AS risk_score, o_orderkey % 301 = 0 AS is_sanctioned, o_orderkey % 103 = 0 AS is_pep, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS kyc, '+' || (o_orderkey % 4) AS phone, o_totalprice AS price FROM orders)"""


def records(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return S.parquet(spark, d, "orders").select(
        F.col("o_custkey").alias("customer_id"), k.alias("pos"), S.pick(k, SYSTEMS).alias("source_system"), F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        F.concat(F.lit("Customer "), c, F.when(k % 10 == 0, " Ltd").otherwise("")).alias("name"), F.when(k % 4 > 0, F.concat(F.lit("19"), (50 + F.col("o_custkey") % 40).cast("string"), F.lit("-01-02"))).alias("date_of_birth"),
        F.when(k % 5 > 0, F.concat(F.lit("c"), k.cast("string"), F.when(k % 3 == 0, "").otherwise("@"), F.lit("mail"))).otherwise("").alias("email"),
        (k % 101 / 100).alias("risk_score"), (k % 301 == 0).alias("is_sanctioned"), (k % 103 == 0).alias("is_pep"),
        F.when(k % 2 == 0, F.struct(F.col("o_orderdate").cast("timestamp").alias("verification_date"), F.col("o_orderstatus").alias("status"))).alias("kyc_status"),
        F.array(F.struct(F.concat(F.lit("+"), (k % 4).cast("string")).alias("number"))).alias("phones"), F.col("o_totalprice").alias("price"),
    )


# customer 360 ----------------------------------------------------------------


@query("c301_golden_record", f"""SELECT customer_id, arg_min(name, ({PRIORITY_SQL}, pos)) AS name, arg_min(date_of_birth, ({PRIORITY_SQL}, pos)) FILTER (date_of_birth IS NOT NULL) AS date_of_birth,
arg_min(email, (-epoch(updated_at), {PRIORITY_SQL}, pos)) FILTER (email <> '') AS email FROM re GROUP BY 1""", RE)
def _(spark, d):
    return C.golden(records(spark, d), ("name", "date_of_birth", "email"))


@query("c302b_phones", "SELECT customer_id, string_agg(phone || '@' || source_system, ',' ORDER BY pos) AS phones FROM (SELECT customer_id, phone, arg_min(source_system, pos) AS source_system, min(pos) AS pos FROM re GROUP BY 1, 2) GROUP BY 1", RE)
def _(spark, d):
    p = C.nested(records(spark, d), "phones", ("number",), non_empty=True)
    return p.select("customer_id", F.array_join(F.transform("items", lambda x: F.concat(x["number"], F.lit("@"), x["source"])), ",").alias("phones"))


@query("c304_financial_summary", "SELECT o_custkey AS customer_id, count(*) AS account_count, round(sum(o_totalprice), 2) AS total_balance, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS account_types FROM orders GROUP BY 1")
def _(spark, d):
    item = F.struct(F.col("o_totalprice").cast("double").alias("balance"), F.lit(0.0).alias("credit_limit"), F.col("o_orderstatus").alias("account_type"), F.lit("USD").alias("currency"))
    a = S.parquet(spark, d, "orders").select(F.col("o_custkey").alias("customer_id"), F.array(item).alias("items"))
    return C.financial_summary(a).select("customer_id", "account_count", F.round("total_balance", 2).alias("total_balance"), F.array_join("account_types", ",").alias("account_types"))


@query("c305_risk_profile", """SELECT *, CASE WHEN max_risk >= 0.8 THEN 'critical' WHEN max_risk >= 0.6 THEN 'high' WHEN max_risk >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level FROM (
SELECT customer_id, coalesce(max(risk_score) FILTER (risk_score <> 0), 0)::DOUBLE AS max_risk, round(coalesce(avg(risk_score) FILTER (risk_score <> 0), 0), 6)::DOUBLE AS avg_risk FROM re GROUP BY 1)""", RE)
def _(spark, d):
    return rounded(C.risk_profile(records(spark, d)).drop("risk_factors"), 6, "avg_risk")


@query("c306_kyc_status", "SELECT customer_id, arg_max(kyc, (updated_at, -pos)) FILTER (kyc IS NOT NULL) AS status, bool_or(is_sanctioned) AS is_sanctioned, bool_or(is_pep) AS is_pep FROM re GROUP BY 1", RE)
def _(spark, d):
    return C.kyc_status(records(spark, d)).select("customer_id", F.col("kyc_status.status").alias("status"), "is_sanctioned", "is_pep")


@query("c307_data_quality", f"""SELECT customer_id, round(completeness, 6) AS completeness, round(accuracy, 6) AS accuracy, round(consistency, 6) AS consistency, round(timeliness, 6) AS timeliness, round(uniqueness, 6) AS uniqueness,
round(0.2::DOUBLE * completeness + 0.25::DOUBLE * accuracy + 0.2::DOUBLE * consistency + 0.1::DOUBLE * timeliness + 0.15::DOUBLE * uniqueness + 0.1::DOUBLE, 6) AS overall_score FROM (SELECT customer_id,
((n_name > 0)::INT * 1.0::DOUBLE + (n_dob > 0)::INT * 0.8::DOUBLE + (mail IS NOT NULL)::INT * 0.5::DOUBLE) / {sum(C.REQUIRED.values())}::DOUBLE AS completeness,
coalesce(((coalesce(contains(mail, '@'), false))::INT + (n_dob > 0)::INT)::DOUBLE / nullif((mail IS NOT NULL)::INT + (n_dob > 0)::INT, 0), 1.0) AS accuracy,
coalesce(((n_name >= 2 AND d_name = 1)::INT + (n_dob >= 2 AND d_dob = 1)::INT)::DOUBLE / nullif((n_name >= 2)::INT + (n_dob >= 2)::INT, 0), 1.0) AS consistency, CASE WHEN n > 1 THEN 0.8 ELSE 1.0 END::DOUBLE AS uniqueness, greatest(0.0::DOUBLE, 1 - age / 365) AS timeliness
FROM (SELECT customer_id, count(*) AS n, avg(date_diff('day', updated_at::DATE, DATE '1998-09-01')) AS age, count(name) AS n_name, count(DISTINCT name) AS d_name, count(date_of_birth) AS n_dob, count(DISTINCT date_of_birth) AS d_dob, arg_min(email, (-epoch(updated_at), {PRIORITY_SQL}, pos)) FILTER (email <> '') AS mail FROM re GROUP BY 1))""", RE)
def _(spark, d):
    r = records(spark, d).withColumn("nationality", F.lit(None).cast("string"))
    q = C.data_quality(r, C.golden(r, ("name", "date_of_birth", "email")), datetime(1998, 9, 1))
    cols = ("completeness", "accuracy", "consistency", "timeliness", "uniqueness", "overall_score")
    return rounded(q.select("customer_id", *cols), 6, *cols)


@query("c308_timeline", "SELECT customer_id, string_agg(pos::VARCHAR, ',' ORDER BY updated_at DESC, source_system DESC, pos::VARCHAR DESC) AS events FROM re GROUP BY 1", RE)
def _(spark, d):
    e = records(spark, d).select("customer_id", F.col("updated_at").alias("at"), F.col("source_system").alias("kind"), F.col("pos").cast("string").alias("detail"))
    return C.timeline(e).select("customer_id", F.array_join(F.transform("timeline", lambda x: x["detail"]), ",").alias("events"))


# loans -----------------------------------------------------------------------


@query("lf07_lending_fraud", """SELECT id AS application_id, round(least(1.0, (CASE WHEN id % 12 < 6 AND price > 200000 THEN 0.2 ELSE 0 END + CASE WHEN id % 3 = 0 AND id % 2 = 1 THEN 0.15 ELSE 0 END + CASE WHEN id % 11 = 0 THEN 0.2 ELSE 0 END + CASE WHEN id % 4 > 1 THEN 0.3 ELSE 0 END + CASE WHEN id % 13 = 0 THEN 0.2 ELSE 0 END
+ CASE WHEN n > 5 THEN 0.4 WHEN n > 3 THEN 0.2 ELSE 0 END))::DOUBLE, 6) AS fraud_score FROM (SELECT o_orderkey AS id, o_totalprice AS price, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE fraud_score > 0""")
def _(spark, d):
    o, k = S.parquet(spark, d, "orders"), F.col("o_orderkey")
    device = F.struct((k % 11 == 0).alias("is_vpn"), F.lit(None).cast("boolean").alias("is_proxy"), (k % 4).alias("other_identities_count"), (k % 13 == 0).alias("geo_mismatch"))
    a = o.select(k.alias("application_id"), F.col("o_custkey").alias("applicant_id"), (k % 12).alias("employment_length_months"), F.col("o_totalprice").alias("annual_income"), F.when(k % 3 == 0, "self_employed").otherwise("employed").alias("employment_type"), (k % 2 == 0).alias("business_verified"), device.alias("device_info"))
    history = o.groupBy(F.col("o_custkey").alias("applicant_id")).agg(F.count("*").alias("applications_last_30_days"))
    return rounded(fraud.lending_fraud(a, history).select("application_id", "fraud_score").where("fraud_score > 0"), 6, "fraud_score")


# inferred links and paths ----------------------------------------------------


@query("gr15_company_links", """SELECT src, dst, relationship_type, weight, substr(md5(src || '_' || dst || '_' || relationship_type), 1, 16) AS edge_id FROM (
SELECT s_suppkey % 97 AS src, s_suppkey AS dst, 'DIRECTOR_OF' AS relationship_type, 1.0::DOUBLE AS weight FROM supplier
UNION ALL SELECT s_suppkey % 89, s_suppkey, CASE WHEN s_suppkey % 100 > 50 THEN 'CONTROLS' ELSE 'SHAREHOLDER_OF' END, (s_suppkey % 100)::DOUBLE / 100 FROM supplier UNION ALL SELECT s_suppkey % 83, s_suppkey, 'BENEFICIAL_OWNER', (s_suppkey % 50)::DOUBLE / 100 FROM supplier)""")
def _(spark, d):
    k = F.col("s_suppkey")
    held = lambda m, p: F.array(F.struct((k % m).alias("entity_id"), (k % p).cast("double").alias("percentage")))
    r = S.parquet(spark, d, "supplier").select(k.alias("company_id"), F.array(F.struct((k % 97).alias("entity_id"))).alias("directors"), held(89, 100).alias("shareholders"), held(83, 50).alias("beneficial_owners"))
    return network.relationships_from_companies(r)


@query("gr16_shared_attributes", """SELECT a.id AS src, b.id AS dst, t.k AS relationship_type, t.c::DOUBLE AS confidence FROM ct a JOIN ct b ON a.id < b.id JOIN (VALUES ('CO_LOCATED', 0.7), ('SHARES_PHONE', 0.8)) t(k, c) ON (t.k = 'CO_LOCATED' AND a.id // 3 = b.id // 3) OR (t.k = 'SHARES_PHONE' AND a.id // 2 = b.id // 2)""", "ct AS (SELECT c_custkey AS id FROM customer)")
def _(spark, d):
    k = F.col("c_custkey")
    text = lambda n: F.floor(k / n).cast("string")
    n = S.parquet(spark, d, "customer").select(k.alias("id"), k.alias("ord"), F.create_map(F.lit("address"), text(3), F.lit("phone"), text(2)).alias("attributes"))
    return network.shared_attributes(n).drop("edge_id")


@query("gr18_degree_centrality", "SELECT id, count(*)::DOUBLE AS score FROM (SELECT src AS id FROM ed UNION ALL SELECT dst FROM ed) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", ED)
def _(spark, d):
    v, e = edges_of(spark, d)
    return network.centrality(v, e)


@query("gr20_entity_network", "SELECT id FROM (SELECT id, min(h) AS h FROM (SELECT 3 AS id, 0 AS h UNION ALL SELECT dst, 1 FROM un WHERE src = 3 UNION ALL SELECT b.dst, 2 FROM un a JOIN un b ON a.dst = b.src WHERE a.src = 3) GROUP BY 1 ORDER BY 2, 1 LIMIT 100) JOIN ent USING (id)", UN, ENT)
def _(spark, d):
    v, e = edges_of(spark, d)
    return network.entity_network(v, e, 3)[0].select("id")


@query("gr27_export", "SELECT id, upper(entity_type) AS label, name AS name_property, country AS country_property FROM ent", ENT)
def _(spark, d):
    v = S.entities(spark, d).withColumn("attributes", F.create_map(F.lit("country"), F.col("country")))
    return network.export_records(v).select("id", "label", F.col("properties")["name"].alias("name_property"), F.col("properties")["country"].alias("country_property"))


# workflow and changes of rows ------------------------------------------------


@query("wf_case_changes", "SELECT id, CASE WHEN id = 9 THEN 'closed' WHEN id IN (5, 7) THEN 'sar_filed' WHEN id IN (1, 2, 3) AND status = 'open' THEN 'in_progress' ELSE status END AS status, CASE WHEN id IN (1, 2, 3) THEN 'lead' ELSE assigned_to END AS assigned_to, CASE WHEN id IN (5, 7) THEN 1 ELSE sar_filed END AS sar_filed FROM ca", CA)
def _(spark, d):
    c = workflow.assign_case(S.cases(spark, d), [1, 2, 3], "lead")
    return workflow.close_case(workflow.file_sar(c, [5, 7]), [9], True).select("id", "status", "assigned_to", "sar_filed")


@query("wf_alert_outcomes", "SELECT id, CASE WHEN id IN (2, 4) THEN 'resolved_sar' WHEN id = 6 THEN 'resolved_false_positive' WHEN id = 8 THEN 'escalated' ELSE status END AS status FROM al", AL)
def _(spark, d):
    a = workflow.resolve_alert(workflow.resolve_alert(S.alerts(spark, d), [2, 4], "sar"), [6], "false_positive")
    return workflow.escalate_alert(a, [8]).select("id", "status")


@query("wf_proposal_status", "SELECT id, CASE id WHEN 1 THEN 'submitted' WHEN 2 THEN 'won' WHEN 3 THEN 'withdrawn' ELSE status END AS status FROM pr", PR)
def _(spark, d):
    p = S.proposals(spark, d)
    for i, event in enumerate(("submit", "won", "delete"), 1):
        p = workflow.proposal_status(p, [i], event)
    return p.select("id", "status")


@query("wf_versions", "SELECT p_partkey AS id, (p_partkey % 7) || '.' || (p_size + 1) AS version FROM part")
def _(spark, d):
    v = F.concat_ws(".", (F.col("p_partkey") % 7).cast("string"), F.col("p_size").cast("string"))
    return S.parquet(spark, d, "part").select(F.col("p_partkey").alias("id"), workflow.next_version(v).alias("version"))


@query("snk03_upsert", "SELECT id, CASE WHEN id % 100 = 0 THEN amount + 1 ELSE amount END AS amount FROM tx WHERE id % 100 <> 1", TX)
def _(spark, d):
    t = S.transactions(spark, d).select("id", "amount")
    t = S.upsert(t, t.where("id % 100 = 0").withColumn("amount", F.col("amount") + 1))
    return S.remove(t, t.where("id % 100 = 1").select("id"))


@query("snk03_partial_update", "SELECT id, CASE WHEN id % 100 = 0 THEN 'closed' ELSE status END AS status, severity FROM al", AL)
def _(spark, d):
    a = S.alerts(spark, d).select("id", "status", "severity")
    return S.partial_update(a, a.where("id % 100 = 0").select("id", F.lit("closed").alias("status"), F.lit(None).cast("string").alias("severity"), F.array(F.lit("status")).alias("fields")))
