"""Windows over events, for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) over tumbling or sliding windows; the watermark acts on streams only."""
    frame = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(frame.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n) of runs of events no further apart than the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def usage(requests: DataFrame, by: str, at: str, items: str, seconds: float = 60.0) -> DataFrame:
    """The requests with ``used``: items of the same key in the ``seconds`` up to each, the far end excluded."""
    frame = f"sum({items}) OVER (PARTITION BY {by} ORDER BY {at} RANGE BETWEEN INTERVAL '{seconds - 1e-6:.6f}' SECOND PRECEDING AND CURRENT ROW)"
    return requests.withColumn("used", F.expr(frame))
