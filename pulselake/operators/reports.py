"""Catalogues, audits and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import drift


def metric_catalog(m: DataFrame) -> DataFrame:
    """One row for each metric: kind, rows, sources, first and last instant, units."""
    return m.groupBy("metric").agg(F.min("record_kind").alias("record_kind"), F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_sources"), F.min("start_ts").alias("first_ts"), F.max("start_ts").alias("last_ts"), F.array_join(F.array_sort(F.collect_set("unit")), ", ").alias("units"))


def source_counts(m: DataFrame) -> DataFrame:
    return m.groupBy("source").agg(F.count("*").alias("n_rows"), F.countDistinct("metric").alias("n_metrics"), F.min("start_ts").alias("first_ts"), F.max("start_ts").alias("last_ts"))


def drift_report(actual: DataFrame, expected: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(name, actual, expected, state) of ``actual(name, n)`` against ``expected(name, n)``; what is missing counts 0."""
    j = expected.select("name", F.col("n").alias("expected")).join(actual.select("name", F.col("n").alias("actual")), "name", "left")
    a = F.coalesce("actual", F.lit(0))
    return j.select("name", a.alias("actual"), "expected", drift(a, F.col("expected"), tolerance).alias("state"))


def spot_checks(m: DataFrame, expected: dict[str, int], tolerance: float = 0.02) -> DataFrame:
    """(name, actual, expected, state) of the row counts of these metrics; a metric without rows counts 0."""
    want = m.sparkSession.createDataFrame(list(expected.items()), "name string, n long")
    return drift_report(m.where(F.col("metric").isin(*expected)).groupBy(F.col("metric").alias("name")).agg(F.count("*").alias("n")), want, tolerance)


def mapping_audit(categorized: DataFrame) -> DataFrame:
    """(metric, label, ordinal, n) of the mapped values."""
    return categorized.where("value_label is not null").groupBy("metric", F.col("value_label").alias("label")).agg(F.min("value_ordinal").alias("ordinal"), F.count("*").alias("n"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """(column, n, pct) of each value."""
    g = df.groupBy(column).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("_all")))).select(column, "n", (100.0 * F.col("n") / F.col("_all")).alias("pct"))


def save(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace the table under ``path``."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
