"""Batch jobs from the command line: ``python -m sentrail.jobs monitor|resolve|network ...``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import monitoring, network, resolution
from .session import materialize, session
from .sources import tables as S


def monitor(spark: SparkSession, input: str, output: str, rules: Sequence[str] | None = None) -> DataFrame:
    """Entity risks and alerts of the named rules, and a row of totals."""
    return monitoring.run_pipeline(S.read_transactions(spark, input), output, tuple(rules) if rules else tuple(monitoring.RULES))


def resolve(spark: SparkSession, input: str, output: str, threshold: float = 0.8) -> DataFrame:
    """Star clusters of entities with alike names, and a row of totals."""
    resolution.resolve_job(S.read_entities(spark, input), threshold).write.mode("overwrite").parquet(output)
    return resolution.job_stats(spark.read.parquet(output))


def analyse(spark: SparkSession, transactions: str, entities: str, output: str) -> DataFrame:
    """Every network result in a folder of its own, and the number of rows of each."""
    v, e = network.graph(spark.read.parquet(transactions), spark.read.parquet(entities))
    e = materialize(e, "job-edges")
    parts = {
        "centrality": network.pagerank(v, e), "communities": network.community_stats(v, network.label_propagation(v, e)), "circular_flows": network.circular_flows(e),
        "passthrough": network.pass_through(e), "bridges": network.bridge_entities(v, e), "reciprocal_flows": network.reciprocal_flows(e),
    }
    out = None
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{output}/{name}")
        n = spark.read.parquet(f"{output}/{name}").agg(F.lit(name).alias("result"), F.count("*").alias("row_count"))
        out = n if out is None else out.unionByName(n)
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    p = argparse.ArgumentParser(prog="sentrail.jobs")
    jobs = p.add_subparsers(dest="job", required=True)
    m = jobs.add_parser("monitor")
    m.add_argument("--input", required=True)
    m.add_argument("--output", required=True)
    m.add_argument("--rules", nargs="+", choices=sorted(monitoring.RULES))
    r = jobs.add_parser("resolve")
    r.add_argument("--input", required=True)
    r.add_argument("--output", required=True)
    r.add_argument("--threshold", type=float, default=0.8)
    n = jobs.add_parser("network")
    for o in ("--transactions", "--entities", "--output"):
        n.add_argument(o, required=True)
    a = vars(p.parse_args(argv))
    job = {"monitor": monitor, "resolve": resolve, "network": analyse}[a.pop("job")]
    out = job(spark or session(f"sentrail {job.__name__}"), **a)
    out.show(truncate=False)
    return out


if __name__ == "__main__":
    main()
