"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "seaweft", master: str | None = None, **conf: object) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` adds settings, dots written as double underscores."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, str(v))
    return b.getOrCreate()
