"""Where the catalogue's queries and their SQL are kept, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ZONE = "Europe/Budapest"
DAY = "cast((ts at time zone 'UTC') at time zone 'Europe/Budapest' as date)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact(c) -> F.Column:
    """Sum of doubles in decimals: the same in any order."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,6)")).cast("double")
