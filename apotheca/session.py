"""The Spark session that the engine runs in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "apotheca", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive planning with skew handling, Arrow; on a cluster sizes come from its own settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (fixed | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
