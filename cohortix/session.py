"""A Spark session with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "cohortix", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on (coalesced and split partitions), UTC; ANSI mode stays on. conf: more settings, `.` written as `__`."""
    build = SparkSession.builder.appName(name)
    if master:
        build = build.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        build = build.config(k, v)
    return build.getOrCreate()
