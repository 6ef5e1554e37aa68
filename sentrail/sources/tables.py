"""The domain's tables as views of the driver's, and readers and writers of the domain's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Countries by number.
CODES = ("KP", "IR", "MM", "SY", "YE", "AF", "PK", "VE", "ZW", "KY", "VG", "PA", "BZ", "US", "GB", "DE", "FR", "ES", "IT", "NL", "CH", "SG", "JP", "CA", "AU")
ENTITY_SCHEMA = "id string, name string, entity_type string, source_system string, attributes string, created_at timestamp"
TRANSACTION_SCHEMA = "id string, transaction_type string, amount double, currency string, sender_entity_id string, receiver_entity_id string, sender_country string, receiver_country string, transaction_date timestamp, is_flagged int, risk_score double"

# Members of enumerations, in order of declaration.
SEVERITY = ("low", "medium", "high", "critical")
ALERT_STATUS = ("new", "investigating", "escalated", "resolved_sar", "resolved_false_positive", "closed")
CASE_STATUS = ("open", "in_progress", "pending_review", "escalated", "sar_filed", "closed_no_action", "closed")
PROPOSAL_STATUS = ("draft", "in_progress", "review", "submitted", "won", "lost", "no_bid", "withdrawn")
PROPOSAL_TYPE = ("rfp", "rfi", "rfq", "eoi")
PRIORITY = ("low", "medium", "high", "critical")
ENGAGEMENT_TYPE = ("poc", "pilot", "trial", "prototype", "workshop", "demo", "business_case")
ENGAGEMENT_STATUS = ("planning", "in_progress", "on_hold", "completed", "successful", "unsuccessful", "cancelled")
DEMO_TYPE = ("standard", "custom", "deep_dive", "executive", "technical", "webinar")


def code(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CODES)), (n % 25).cast("int") + 1)


def pick(n: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parquet(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("transaction_type"), F.round(F.col("value") * 100, 2).alias("amount"), F.lit("USD").alias("currency"), F.col("user_id").alias("sender_entity_id"),
        k.alias("receiver_entity_id"), code(F.col("user_id")).alias("sender_country"), code(k).alias("receiver_country"), F.col("ts").cast("timestamp").alias("transaction_date"),
        (F.col("event_type") == "error").cast("int").alias("is_flagged"), (F.col("event_id") % 100 / 100.0).alias("risk_score"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return parquet(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("entity_type"), (k % 101 / 100.0).alias("risk_score"), (k % 97 == 0).cast("int").alias("is_sanctioned"),
        (k % 41 == 0).cast("int").alias("is_pep"), (k % 53 == 0).cast("int").alias("is_adverse_media"), code(F.col("c_nationkey")).alias("country"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return parquet(spark, sf_dir, "orders").select(
        k.alias("id"), pick(k, ALERT_STATUS).alias("status"), pick(F.substring("o_orderpriority", 1, 1).cast("int"), SEVERITY).alias("severity"), F.concat(F.lit("cat"), (k % 4).cast("string")).alias("category"),
        F.concat(F.lit("rule"), (k % 13).cast("string")).alias("rule_name"), (k % 100 / 100.0).alias("confidence_score"), F.concat(F.lit("analyst"), (k % 7).cast("string")).alias("assigned_to"),
        F.col("o_custkey").alias("primary_entity_id"), F.col("o_orderdate").cast("timestamp").alias("detected_at"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return parquet(spark, sf_dir, "orders").select(
        k.alias("id"), pick(k, CASE_STATUS).alias("status"), pick(k, ("aml", "fraud", "sanctions")).alias("case_type"), F.concat(F.lit("cat"), (k % 4).cast("string")).alias("category"), F.concat(F.lit("analyst"), (k % 7).cast("string")).alias("assigned_to"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").cast("timestamp").alias("opened_at"), (k % 101 / 100.0).alias("overall_risk_score"), (k % 6 == 3).cast("int").alias("sar_filed"),
    )


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    area = ("aml", "fraud", "kyc", "sanctions", "network")
    return parquet(spark, sf_dir, "orders").select(
        k.alias("id"), pick(k, PROPOSAL_STATUS).alias("status"), pick(k, PROPOSAL_TYPE).alias("proposal_type"), pick(k, PRIORITY).alias("priority"), F.when(k % 9 != 0, pick(k, ("banking", "insurance", "retail"))).alias("client_industry"),
        F.concat(F.lit("Client "), (k % 50).cast("string")).alias("client_name"), F.concat(F.lit("owner"), (k % 6).cast("string")).alias("lead_owner"), F.col("o_totalprice").alias("estimated_deal_value"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("interval 30 days")).alias("due_date"), F.col("o_orderdate").cast("timestamp").alias("decision_date"), F.array(pick(k, area), pick(k + 2, area)).alias("solution_areas"),
    )


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entity records with the declared schema."""
    return spark.read.schema(ENTITY_SCHEMA).parquet(path)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRANSACTION_SCHEMA).parquet(path)


def read_json_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array file, or records with a declared schema."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'name | entity type | note'; lines that begin with # and empty ones are left out."""
    parts = F.split("value", r"\s*\|\s*")
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    return lines.select(F.trim(F.get(parts, 0)).alias("name"), F.trim(F.get(parts, 1)).alias("entity_type"))


def engagements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return parquet(spark, sf_dir, "orders").select(
        k.alias("id"), pick(k, ENGAGEMENT_STATUS).alias("status"), pick(k + 1, ENGAGEMENT_TYPE).alias("engagement_type"), F.concat(F.lit("Trial "), (k % 90).cast("string")).alias("title"),
        F.concat(F.lit("Client "), (k % 50).cast("string")).alias("client_name"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def demos(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return parquet(spark, sf_dir, "orders").select(
        k.alias("id"), pick(k, DEMO_TYPE).alias("demo_type"), F.when(k % 3 == 0, "scheduled").otherwise("done").alias("status"), F.concat(F.lit("presenter"), (k % 8).cast("string")).alias("presenter"),
        F.concat(F.lit("Client "), (k % 50).cast("string")).alias("client_name"), F.col("o_orderdate").cast("timestamp").alias("scheduled_at"), F.when(k % 4 > 0, k % 5 + 1).alias("rating"),
    )


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios and content alike, of which some are out of use."""
    k = F.col("p_partkey")
    return parquet(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_name").alias("name"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.col("p_type").alias("content"), F.col("p_brand").alias("category"),
        pick(k, ("aml", "fraud", "kyc", "sanctions", "network")).alias("solution_area"), (k % 4 > 0).cast("int").alias("is_active"), (k % 3 > 0).cast("int").alias("is_current"),
        F.col("p_size").alias("times_used"), (k * 7 % 101).alias("usage_count"),
    )


def serialised(df: DataFrame, booleans: tuple[str, ...] = ()) -> DataFrame:
    """Rows as an interface gives them: times in ISO form without a zone, flags of 0 and 1 as booleans."""
    out = {}
    for f in df.schema.fields:
        if f.dataType.simpleString().startswith("timestamp"):
            c = F.col(f.name)
            out[f.name] = F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        elif f.name in booleans:
            out[f.name] = F.coalesce(F.col(f.name).cast("boolean"), F.lit(False))
    return df.withColumns(out) if out else df


def json_records(df: DataFrame) -> DataFrame:
    """``(json)``: each row as one JSON object, null fields included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 32) -> DataFrame:
    """A database table read in ``parts`` key ranges."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()


def write(df: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = ()) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def upsert(base: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``base`` with the rows of equal key replaced and new ones added."""
    return base.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def remove(base: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def partial_update(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Set the fields that ``changes`` names in its array ``fields``; a named null overwrites."""
    c = changes.select(*[F.col(x).alias(f"__{x}") for x in changes.columns])
    joined = base.join(c, base[key] == c[f"__{key}"], "left")
    cols = [F.when(F.array_contains("__fields", x), F.col(f"__{x}")).otherwise(F.col(x)).alias(x) if x in changes.columns and x != key else F.col(x) for x in base.columns]
    return joined.select(*cols)
