"""Search over entities, transactions and alerts: the set of hits and the filters, with a word-match score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .screening import close, tokens


def relevance(query: str, fields: Mapping[str, float], fuzzy: bool = False) -> Column:
    """Boosted share of the query's words that are (or, ``fuzzy``, are close to) a word of each field."""
    q, total = tokens(F.lit(query)), F.lit(0.0)
    for c, boost in fields.items():
        total = total + boost * matched(q, F.col(c).cast("string"), fuzzy) / F.greatest(F.lit(1), F.size(q))
    return total


def matched(q: Column, field: Column, fuzzy: bool) -> Column:
    words = tokens(field)
    return F.size(F.filter(q, lambda x: F.exists(words, lambda t: close(x, t)))) if fuzzy else F.size(F.array_intersect(q, words))


def hits(df: DataFrame, query: str, fields: Mapping[str, float], fuzzy: bool = False) -> DataFrame:
    return df.withColumn("relevance", relevance(query, fields, fuzzy)).where("relevance > 0")


def search_entities(entities: DataFrame, query: str, types: Sequence[str] | None = None, min_risk: float = 0.0, max_risk: float = 1.0, skip: int = 0, size: int = 20, attributes: Sequence[str] = ()) -> DataFrame:
    """Entities by a fuzzy match of name and ``attributes``, the riskiest first."""
    e = entities.where(F.col("risk_score").between(min_risk, max_risk))
    e = e.where(F.col("entity_type").isin(*types)) if types else e
    found = hits(e, query, {"name": 3.0} | dict.fromkeys(attributes, 1.0), True)
    return found.orderBy(F.desc("risk_score"), F.desc("relevance"), "id").offset(skip).limit(size)


def search_transactions(tx: DataFrame, query: str, fields: Sequence[str] = ("description", "reference_number"), skip: int = 0, size: int = 20) -> DataFrame:
    return hits(tx, query, dict.fromkeys(fields, 1.0)).orderBy(F.desc("relevance"), "id").offset(skip).limit(size)


ALERT_FIELDS = {"title": 2.0, "description": 1.0}


def search_alerts(alerts: DataFrame, query: str, fields: Mapping[str, float] = ALERT_FIELDS, severity: str | None = None, status: str | None = None, skip: int = 0, size: int = 20) -> DataFrame:
    for c, v in (("severity", severity), ("status", status)):
        alerts = alerts.where(F.col(c) == v) if v else alerts
    return hits(alerts, query, fields).orderBy(F.desc("relevance"), "id").offset(skip).limit(size)


def search_all(parts: Mapping[str, DataFrame], query: str, skip: int = 0, size: int = 10) -> DataFrame:
    """``(index, id, relevance)``: the best hits of each table over all its text columns."""
    out = None
    for name, df in parts.items():
        fields = {f.name: 1.0 for f in df.schema.fields if f.dataType.simpleString() == "string"}
        best = hits(df, query, fields).orderBy(F.desc("relevance"), "id").offset(skip).limit(size)
        p = best.select(F.lit(name).alias("index"), F.col("id").cast("string").alias("id"), "relevance")
        out = p if out is None else out.unionByName(p)
    if out is None:
        raise ValueError("no tables to search")
    return out


def suggest(entities: DataFrame, prefix: str, size: int = 10) -> DataFrame:
    """Distinct names that begin with ``prefix``, letter case as given."""
    return entities.where(F.col("name").startswith(prefix)).select("name").distinct().orderBy("name").limit(size)


def index_documents(index: DataFrame, documents: DataFrame, key: str = "id") -> DataFrame:
    """The index with documents of equal key replaced and new ones added."""
    return index.join(documents.select(key), key, "left_anti").unionByName(documents, allowMissingColumns=True)


def delete_documents(index: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return index.join(keys.select(key), key, "left_anti")
