"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "palisade", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; conf entries (dots as __) override."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
