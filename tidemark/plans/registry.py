"""All registered queries of the core, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cleaning, relational, similarity, streams, tracking

PARTS = [tracking, similarity, relational, streams, cleaning]


def queries() -> dict:
    return {k: q for part in PARTS for k, q in part.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: q for part in PARTS for k, q in part.ORACLES.items()}


def entry(spark: SparkSession, d: str) -> DataFrame:
    return queries()["speed_zones"](spark, d)
