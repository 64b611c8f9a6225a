"""A session with what the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidegrid", **conf: str) -> SparkSession:
    """UTC times, adaptive plans with skew handling; everything else as the cluster is configured."""
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    b = SparkSession.builder.appName(app)
    for k, v in (fixed | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
