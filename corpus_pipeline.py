"""A cleaning pipeline over ``documents``: each stage works on all rows that the one before kept.

In every stage null texts count as empty ones, texts of any length are looked at whole, null
and repeated ids are allowed, and an empty table gives an empty one. The filtering stages
return the columns of their input, whatever their names, and one row for each row that stays;
what they compare and which row of a group stays is said in the operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentrail.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from sentrail.llm.queries import table, tokenizer_path
from sentrail.session import materialize, release, scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; learnt from ``labels`` and these documents."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more.

    Links of SimHash over anchors, checked, and an exact way for those that SimHash misses.
    """
    return near_dedup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in training sequences."""
    return packing.pack(docs, tokenizer_path()).withColumnRenamed("doc", "doc_id")


STAGES = [("toxicity", reject_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack_sequences)]

#: Near-duplicates, toxicity scores and packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again by the next; only the last one's table stays there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as tables:
            done = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            tables.remove(done)
        release(docs)
        docs = done
    return docs
