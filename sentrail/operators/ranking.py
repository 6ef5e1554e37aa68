"""Ranked search: an inverted index written once, and BM25 over the postings of a query's terms.

The index is three tables: ``postings`` (term, field, id, tf, length) in folders by a hash of the term and in
order of the term within each file, ``terms`` (term, field, df) in the same folders, and ``fields`` (field, n, mean) with a row for
each field. A query opens only the folders of its terms, and the scan skips the row groups that do not hold them.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, owned, shared_dir
from .screening import close

K1, B = 1.2, 0.75
BUCKETS = 32


@dataclass
class Index:
    postings: DataFrame
    terms: DataFrame
    fields: DataFrame


def words(c: Column) -> Column:
    """Lower-case words in order, with repeats."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\W+"), lambda t: t != "")


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build_index(docs: DataFrame, fields: Sequence[str], path: str | None = None, key: str = "id") -> Index:
    """The index of ``fields`` of ``docs`` at ``path`` (else in the shared folder); ``key`` must be unique. Null and wordless fields are in no list and no mean."""
    spark, own = docs.sparkSession, path is None
    path = path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), words(F.col(f).cast("string")).alias("words")) for f in fields]))
    texts = docs.select(F.col(key).alias("id"), each.alias("e")).select("id", "e.field", "e.words").where("size(words) > 0")
    hits = texts.select("id", "field", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("term", "field", "id").agg(F.count("*").alias("tf"), F.max("length").alias("length"))
    dealt = hits.withColumn("bucket", bucket(F.col("term"))).repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "field", "id")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    kind = docs.schema[key].dataType.simpleString()
    terms = read(spark, path, "postings", kind).groupBy("bucket", "term", "field").agg(F.count("*").alias("df"))
    terms.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    texts.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).write.parquet(f"{path}/fields")
    out = open_index(spark, path, kind)
    if own:
        owned(out.fields, path)
    return out


def open_index(spark: SparkSession, path: str, kind: str = "bigint") -> Index:
    """The index at ``path`` of rows whose ids are of the type ``kind``."""
    return Index(*[read(spark, path, t, kind) for t in ("postings", "terms", "fields")])


def read(spark: SparkSession, path: str, name: str, kind: str) -> DataFrame:
    columns = {"postings": f"term string, field string, id {kind}, tf bigint, length int, bucket int", "terms": "term string, field string, df bigint, bucket int", "fields": "field string, n bigint, mean double"}
    return spark.read.schema(columns[name]).parquet(f"{path}/{name}")


def query_terms(index: Index, query: str, fields: Sequence[str], fuzzy: bool = False) -> DataFrame:
    """``(bucket, term, field, df, weight)``: the index's terms that are words of the query (or, ``fuzzy``, close to one).

    A close term weighs 1 - edits / shorter length; one that is close to several words weighs the sum.
    """
    spark = index.terms.sparkSession
    asked = spark.range(1).select(F.array_distinct(words(F.lit(query)))).first()[0]  # the query's own words
    known = index.terms.where(F.col("field").isin(*fields))
    if not asked:
        return known.limit(0).withColumn("weight", F.lit(1.0))
    if not fuzzy:
        return known.where(F.col("bucket").isin(*buckets_of(spark, asked)) & F.col("term").isin(*asked)).withColumn("weight", F.lit(1.0))
    edits = lambda w: F.levenshtein(w, F.col("term"))
    weight = lambda w: F.when(close(w, F.col("term")), 1 - edits(w) / F.least(F.length(w), F.length("term"))).otherwise(0.0)
    total = F.aggregate(F.array(*map(F.lit, asked)), F.lit(0.0), lambda s, w: s + weight(w))
    longest = F.length("term").between(min(map(len, asked)) - 2, max(map(len, asked)) + 2)
    return known.where(longest).withColumn("weight", total).where("weight > 0")


def buckets_of(spark: SparkSession, terms: Sequence[str]) -> list[int]:
    return [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket(F.col("t"))).distinct().collect()]


def ranked(index: Index, query: str, boosts: Mapping[str, float], fuzzy: bool = False) -> DataFrame:
    """``(id, relevance)`` of the rows that hold a term of the query.

    A field's score is the BM25 sum over the terms found in it, times its boost; a row's is that of its best
    field, to nine digits, so that ties do not hang on the order of sums. Only the postings of the query's terms are
    read: by literal terms, or for a fuzzy query by the folders that its terms are in and a join.
    """
    spark = index.postings.sparkSession
    chosen = query_terms(index, query, list(boosts), fuzzy).join(F.broadcast(index.fields), "field")  # a row for each field
    chosen = materialize(chosen, "terms")
    opened = [r[0] for r in chosen.select("bucket").distinct().collect()]  # at most BUCKETS
    found = index.postings.where(F.col("bucket").isin(*opened) & F.col("field").isin(*boosts)) if opened else index.postings.limit(0)
    if not fuzzy:
        found = found.where(F.col("term").isin(*[r[0] for r in chosen.select("term").distinct().collect()] or [""]))  # words of the query
    n, df, tf = F.col("n"), F.col("df"), F.col("tf")
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    part = F.col("weight") * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = found.join(chosen, ["bucket", "term", "field"]).select("id", "field", part.alias("s"))
    sums = scored.groupBy("id").agg(*[F.sum(F.when(F.col("field") == f, F.col("s"))).alias(f"s{i}") for i, f in enumerate(boosts)])
    best = [F.coalesce(F.col(f"s{i}") * b, F.lit(0.0)) for i, b in enumerate(boosts.values())]
    return sums.select("id", F.round(F.greatest(*best, F.lit(0.0)), 9).alias("relevance"))


def ranked_entities(entities: DataFrame, index: Index, query: str, types: Sequence[str] | None = None, min_risk: float = 0.0, max_risk: float = 1.0, skip: int = 0, size: int = 20, attributes: Sequence[str] = ()) -> DataFrame:
    """Entities by a fuzzy match of name and ``attributes``, the riskiest first, then the most relevant."""
    e = entities.where(F.col("risk_score").between(min_risk, max_risk))
    e = e.where(F.col("entity_type").isin(*types)) if types else e
    hits = ranked(index, query, {"name": 3.0} | dict.fromkeys(attributes, 1.0), True)
    return e.join(hits, "id").orderBy(F.desc("risk_score"), F.desc("relevance"), "id").offset(skip).limit(size)


def best_rows(rows: DataFrame, hits: DataFrame, skip: int = 0, size: int = 20) -> DataFrame:
    """The rows of ``hits``, the most relevant first."""
    return rows.join(hits, "id").orderBy(F.desc("relevance"), "id").offset(skip).limit(size)


def ranked_all(indexes: Mapping[str, tuple[Index, Sequence[str]]], query: str, size: int = 10) -> DataFrame:
    """``(index, id, relevance)``: the best hits of each index over its fields."""
    out = None
    for name, (index, fields) in indexes.items():
        best = ranked(index, query, dict.fromkeys(fields, 1.0)).orderBy(F.desc("relevance"), "id").limit(size)
        part = best.select(F.lit(name).alias("index"), F.col("id").cast("string").alias("id"), "relevance")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no indexes to search")
    return out


def screen_ranked(entities: DataFrame, index: Index, query: str, threshold: float = 0.8, limit: int = 10) -> DataFrame:
    """Sanctioned entities whose name scores at least ``threshold`` of the best one's, by the index of their names."""
    hits = ranked(index, query, {"name": 1.0}, True).join(entities.where("is_sanctioned = 1"), "id").withColumnRenamed("relevance", "match_score")
    best = hits.agg(F.max("match_score").alias("best"))
    return hits.crossJoin(F.broadcast(best)).where(F.col("match_score") >= threshold * F.col("best")).drop("best").orderBy(F.desc("match_score"), "id").limit(limit)  # best is one row
