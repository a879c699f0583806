"""Queries of this subpackage and their SQL, and what its operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronotext.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Bytes of one Arrow batch: long texts then travel in few rows at a time.
BATCH_BYTES = "8m"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with this package's settings and Arrow batches bounded by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return configure(spark)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query that takes (spark, folder of tables)."""

    def register(run: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: run(prepared(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
