"""A session with the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "larkspur", **conf: str) -> SparkSession:
    """UTC times, adaptive execution, and whatever else is given (dots as double underscores)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
