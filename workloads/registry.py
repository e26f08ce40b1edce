"""Registered queries, each kept next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import workloads
from docmatch import configure

Query = Callable[[SparkSession, str], DataFrame]

# Tables whose rows carry texts or vectors, so that work per row is large.
SPREAD = ("documents", "conversations", "embeddings")

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark, workloads), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A file with fewer splits than there are cores is dealt out to all of them; at
    scale there are more splits than cores and nothing moves.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in SPREAD and df.rdd.getNumPartitions() < cores else df
