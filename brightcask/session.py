"""Session settings that the engine is written for. On a cluster, master and memory come from spark-submit."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "brightcask", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; anything given in conf (dots as double underscores) wins."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.runSQLOnFiles": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
