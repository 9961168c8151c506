"""A session with the settings that the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "palimpsest", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution; everything about size is left to the cluster unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
