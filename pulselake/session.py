"""Session and settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "pulselake", **conf: str) -> SparkSession:
    """A session with UTC instants, ANSI arithmetic and adaptive execution; ``conf`` adds or overrides."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """A setting from the session (pulselake.<name>) or the environment (PULSELAKE_<NAME>)."""
    return spark.conf.get(f"pulselake.{name}", None) or os.environ.get(f"PULSELAKE_{name.upper()}", default)


def has_setting(spark: SparkSession, name: str) -> bool:
    return bool(setting(spark, name))
