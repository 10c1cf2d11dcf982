"""Session settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "namesift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive plans on; further settings by keyword, dots written as two underscores."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
