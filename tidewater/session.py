"""A Spark session with the settings that the engine assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidewater", **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; what is given in conf comes on top. Keys may write `_` for `.`."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    base |= {k.replace("_", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=base).getOrCreate()
