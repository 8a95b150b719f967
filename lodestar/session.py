"""Session defaults: adaptive execution decides partition counts and splits skewed joins."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lodestar", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
