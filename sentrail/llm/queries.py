"""One query for each operation over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches
from . import decontaminate, exact_dedup, packing, repair, secret_scan, sharding, simhash, substring, token_count, toxicity, trie, url_filter, warc

SHARD_BYTES, SMALL_SHARD_BYTES = 16 << 20, 64 << 10
TOKENIZER = "word_bpe_49k.json"
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.assign_shards(docs, "doc_id", F.octet_length(F.coalesce("text", F.lit(""))), SHARD_BYTES).withColumnRenamed("key", "doc_id")


def shard_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under a limit that small tables exceed too, so that shards of several depths are compared with SQL."""
    docs = table(spark, sf_dir, "documents")
    return sharding.assign_shards(docs, "doc_id", F.octet_length(F.coalesce("text", F.lit(""))), SMALL_SHARD_BYTES).withColumnRenamed("key", "doc_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("doc", "doc_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(url_filter.labelled_urls(), "url string, unwanted int")
    judged = url_filter.judge(table(spark, sf_dir, "pages"), url_filter.train(labelled), URL_RULES)
    return judged.select(F.col("page").alias("page_id"), "host", "path", "rule", "verdict", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("doc", "doc_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)
    return out.withColumnsRenamed({"doc": "doc_id", "keep": "keep_id", "sha256": "text_sha256"})


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumnRenamed("doc", "doc_id")


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.captures_from_pages(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return out.withColumn("headers", F.array_join(lines, "\n"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).withColumnRenamed("doc", "doc_id")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = spark.createDataFrame(secret_scan.labelled_findings(), "text string, start long, end long, secret int")
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.train(findings)).withColumnRenamed("doc", "doc_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.turns_of(table(spark, sf_dir, "conversations"))
    return trie.trie_nodes(trie.with_shared_starts(turns), turns.select("conv").distinct())


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.repair(rows.select(F.col("conv_id").alias("conv")).distinct(), repair.damaged(rows))


QUERIES = {f.__name__: f for f in (op1_sharding, shard_depths, op2_decontaminate, op3_token_counts, op4_url_filter, op5_packing, op6_exact_dedup, op7_toxicity, op8_revisits, op9_simhash, op10_substring, op11_secrets, op12_prefix_trie, op13_repair)}


def shard_sql(limit: int) -> str:
    return f"""
WITH rows_ AS (
  SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS a, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents
), sums AS (
  SELECT d, a >> (60 - d) AS p, sum(n_bytes) AS size, count(*) AS n FROM rows_, range(0, 31) t(d) GROUP BY ALL
), leaf AS (
  SELECT r.doc_id, r.n_bytes, r.a, s.d, s.size, row_number() OVER (PARTITION BY r.doc_id ORDER BY s.d) AS k
  FROM rows_ r, range(0, 31) t(d) JOIN sums s ON s.d = t.d AND s.p = r.a >> (60 - t.d) WHERE s.size <= {limit} OR s.n = 1
)
SELECT doc_id AS doc_id, n_bytes::BIGINT AS n_bytes, substr(lpad(format('{{:b}}', a), 60, '0'), 1, d::INT) AS shard, d::INT AS depth, size::BIGINT AS shard_bytes FROM leaf WHERE k = 1
"""


ORACLE_SQL = {
    "op1_sharding": shard_sql(SHARD_BYTES),
    "shard_depths": shard_sql(SMALL_SHARD_BYTES),
    "op6_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1 AS kept, h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h)
""",
    "op12_prefix_trie": r"""
WITH convs AS (
  SELECT c, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))) AS crc FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)
), starts AS (
  SELECT c, c - c % 5 AS base, xor(crc, 4294967295) % 9 AS h FROM convs
), turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS v FROM conversations
), rebuilt AS (
  SELECT s.c, 0 AS part, t.pos, t.v FROM starts s JOIN turns t ON t.c = s.base AND t.pos <= s.h
  UNION ALL SELECT s.c, 1, t.pos, t.v FROM starts s JOIN turns t ON t.c = s.c AND t.pos > s.h
), path AS (
  SELECT c, row_number() OVER w AS d, list(v) OVER w AS node, octet_length(encode(v.t)) AS b FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, [], 0 FROM convs
), nodes AS (
  SELECT d, node, min(c) AS conv_id, count(*) AS n, any_value(b) AS b FROM path GROUP BY ALL
), family AS (
  SELECT a.d, a.node, count(*) FILTER (u.d = a.d + 1) AS kids, sum((u.n - 1) * u.b) AS saved, count(*) FILTER (NOT EXISTS (FROM nodes k WHERE k.d = u.d + 1 AND k.node[1:u.d] = u.node)) AS leaves
  FROM nodes a JOIN nodes u ON u.d >= a.d AND u.node[1:a.d] = a.node GROUP BY ALL
), ends AS (
  SELECT d, node, string_agg(c::VARCHAR, ',' ORDER BY c) AS who FROM (SELECT c, max(d) AS d, arg_max(node, d) AS node FROM path GROUP BY c) GROUP BY ALL
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, f.kids AS n_children, f.leaves AS n_leaves, f.saved::BIGINT AS saved_tokens, sha256(coalesce(e.who, '')) AS ends_sha256
FROM nodes n JOIN family f USING (d, node) LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = n.node[1:n.d - 1] LEFT JOIN ends e ON e.d = n.d AND e.node = n.node
""",
    "op8_revisits": r"""
WITH base AS (
  SELECT page_id AS p, regexp_replace(trim(coalesce(url, '')), '#.*$', '') AS u, '"' || substr(md5(coalesce(html, '')), 1, 8) || '"' AS tag,
    CASE WHEN page_id % 7 <> 0 THEN 't' || (page_id * 60 - 86400) END AS lm, octet_length(encode(coalesce(html, ''))) AS size FROM pages
), split AS (
  SELECT *, regexp_extract(u, '^([^?]*)', 1) AS b, regexp_extract(u, '\?(.*)$', 1) AS q FROM base
), heads AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)), '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') AS head,
    regexp_replace(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') AS path,
    array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_'))), '&') AS ps FROM split
), caps AS (
  SELECT p, head || CASE WHEN path = '' AND head <> '' THEN '/' ELSE path END || CASE WHEN ps <> '' THEN '?' || ps ELSE '' END AS url,
    CASE WHEN p % 5 <> 0 THEN tag END AS etag, lm, size,
    CASE WHEN p % 11 = 0 THEN '"changed"' WHEN p % 3 = 0 THEN CASE WHEN p % 5 <> 0 THEN 'W/' || tag END WHEN p % 17 <> 0 THEN CASE WHEN p % 5 <> 0 THEN tag END END AS etag2,
    CASE WHEN p % 4 <> 0 THEN lm END AS lm2, 60 * p AS ts, 60 * p + CASE WHEN p % 13 = 0 THEN -30 ELSE 45 END AS ts2 FROM heads
), pairs AS (
  SELECT v.p, v.url, v.etag2, v.lm2, r.p AS rp, r.etag, r.lm, r.size, row_number() OVER (PARTITION BY v.p ORDER BY r.ts DESC NULLS LAST, r.p DESC) AS k
  FROM caps v LEFT JOIN caps r ON r.url = v.url AND r.ts < v.ts2
), judged AS (
  SELECT *, coalesce(regexp_replace(etag2, '^W/', '') = regexp_replace(etag, '^W/', ''), lm2 = lm) AS ok FROM pairs WHERE k = 1
)
SELECT 2 * p + 1 AS record_id, url, CASE WHEN rp IS NULL THEN 'no_response' WHEN ok IS NULL THEN 'unvalidated' WHEN ok THEN 'resolved' ELSE 'mismatch' END AS status,
  2 * rp AS refers_to, CASE WHEN rp IS NOT NULL AND ok THEN concat_ws(chr(10), 'cache-control: max-age=' || (p % 100), 'content-length: ' || size, 'content-type: text/html', 'date: t' || (60 * p),
  'etag: ' || coalesce(etag2, etag), 'last-modified: ' || lm) END AS headers FROM judged
""",
}
