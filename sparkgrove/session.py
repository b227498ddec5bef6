"""Session defaults: adaptive execution on, UTC, shuffle width left to the caller."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "sparkgrove", **conf: str) -> SparkSession:
    """The active session, or a new one with the defaults above (``conf`` wins)."""
    active = SparkSession.getActiveSession()
    if active is not None and not conf:
        return active
    return SparkSession.builder.appName(app).config(map=DEFAULTS | conf).getOrCreate()
